"""Inputs and outputs: raw text layouts, Parquet tables, derived test inputs."""
