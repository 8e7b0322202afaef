"""The three reports: tourists, residents, representative routes.

    python -m wanderlens.plans.reports tourist --root R --out O --province P --month 201508
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wanderlens.plans.catalog import Catalog
from wanderlens.sources.readers import ParquetInputs, RawInputs
from wanderlens.sources.stored import drop_stored
from wanderlens.sources.writers import FORMATS, write_partitions

# Tables that later results build on come first; they are read back instead of computed again.
TOURIST_BASE = {"visitor": "visitor_detect", "transport": "transport_out", "home": "visitor_home"}
TOURIST_RESULTS = [
    "hot_routes_short", "hot_routes_long", "hot_routes_deep", "visitor_flow_by_prov", "home_place_count",
    "daily_in_out", "stay_days_hist", "migration_day", "migration_month", "prov_by_transport",
    "spot_flow_day_hour", "spot_flow_month", "spot_flow_prov_day", "spot_flow_prov_month", "spot_avg_stay",
    "spot_stay_hist", "visitor_profile", "spot_rank",
]
RESULTS = {
    "tourist": TOURIST_RESULTS,
    "resident": ["resident_profile"],
    "routes": ["representative_route"],
}


def run_reports(kind: str, catalogs: dict[tuple[str, str], Catalog], out: str, fmt: str = "parquet") -> list[str]:
    """Write every result of a report for each (province, month); returns the folders.

    A result set is one job over all provinces and months, which replaces their partitions only.
    """
    folders = []

    def write(name: str, result: Callable[[Catalog], DataFrame]) -> None:
        folders.extend(write_partitions({of: result(catalog) for of, catalog in catalogs.items()}, out, name, fmt))

    def fix(*tables: str) -> None:
        for catalog in catalogs.values():
            for table in tables:
                catalog.fix(table)

    if kind == "tourist":
        fix("stops", *TOURIST_BASE)
        for shared, name in TOURIST_BASE.items():
            write(name, lambda catalog, shared=shared: catalog.fix(shared))
        fix("visits", "migration", "routes_of_bands")
    for name in RESULTS[kind]:
        write(name, lambda catalog, name=name: getattr(catalog, name)())
    return folders


def run_report(kind: str, catalog: Catalog, out: str, province: str, month: str, fmt: str = "parquet") -> list[str]:
    """Write every result of a report of one province and month; returns their folders."""
    return run_reports(kind, {(province, month): catalog}, out, fmt)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("report", choices=sorted(RESULTS))
    parser.add_argument("--root", required=True, help="folder of the inputs")
    parser.add_argument("--out", required=True, help="folder of the results")
    parser.add_argument("--province", required=True, help="one, or several with commas between them")
    parser.add_argument("--month", required=True, help="yyyyMM, or several with commas between them")
    parser.add_argument("--input-format", choices=["text", "parquet"], default="text")
    parser.add_argument("--format", choices=FORMATS, default="parquet")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"wanderlens-{args.report}").getOrCreate()
    reader = RawInputs if args.input_format == "text" else ParquetInputs
    catalogs = {
        (province, month): Catalog(reader(spark, args.root, province, month), month)
        for province in args.province.split(",") for month in args.month.split(",")
    }
    try:
        for folder in run_reports(args.report, catalogs, args.out, args.format):
            print(folder)
    finally:
        drop_stored(spark)  # the results are written; what they were built from goes


if __name__ == "__main__":
    main()
