"""Mobility and tourism analytics as typed PySpark DataFrame operators."""
