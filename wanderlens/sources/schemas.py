"""Typed tables the operators work on.

User and cell ids are opaque text; the operators take whole numbers as well.
"""

from __future__ import annotations

TABLES = {
    "visitor_record": "user_id string, ts timestamp_ntz, cell_id string, lng double, lat double, prov int",
    "local_record": "user_id string, ts timestamp_ntz, cell_id string, lng double, lat double, prov int",
    "visitor_stop": "day date, user_id string, ts timestamp_ntz, cell_id string, dur_h double, lng double, lat double",
    "local_stop": "day date, user_id string, ts timestamp_ntz, cell_id string, dur_h double, lng double, lat double",
    "user_home": "user_id string, cell_id string, lng double, lat double",
    "user_work": "user_id string, cell_id string, lng double, lat double",
    "cdr": "call_ts timestamp_ntz, caller string, callee string, dur_ms bigint",
    "base_station": "cell_id string, lng double, lat double, radius_m double",
    "scenic_spot": "scenic_id int, cell_id string",
    "poi": "poi_id bigint, name string, tags string, lng double, lat double, price double",
}

VISITOR = "user_id string, prov int, first_date date, last_date date, stay_days int"
