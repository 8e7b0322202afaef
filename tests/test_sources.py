"""Raw layouts, and the reports from text files against the same reports from the derived tables."""

import pytest
from pyspark.sql import functions as F

from conftest import at, day, rows
from wanderlens.plans.catalog import Catalog
from wanderlens.plans.reports import RESULTS, TOURIST_BASE, run_report, run_reports
from wanderlens.operators import lodging
from wanderlens.sources import readers
from wanderlens.sources.derived import DerivedInputs
from wanderlens.sources.readers import RAW_PATHS, ParquetInputs, RawInputs, import_raw
from wanderlens.sources.schemas import TABLES
from wanderlens.sources.writers import in_partitions

MONTH, PROVINCE = "202401", "HaiNan"


def lines(tmp_path, *text):
    path = tmp_path / "in.csv"
    path.write_text("\n".join(text) + "\n")
    return str(path)


def test_records_and_unknown_places(spark, tmp_path):
    path = lines(tmp_path, "7,20240131235958,12,110.5,20.25,301", "8,20240101000000,12,None,None,302")
    assert rows(readers.read_csv(spark, "record", path)) == [
        ("7", at("31 23:59:58"), "12", 110.5, 20.25, 301), ("8", at("01 00:00:00"), "12", None, None, 302)
    ]


def test_ids_are_opaque_text(spark, tmp_path):
    path = lines(tmp_path, "a3f9c0de11,20240131235958,007,110.5,20.25,301")
    assert rows(readers.read_csv(spark, "record", path), "user_id", "cell_id") == [("a3f9c0de11", "007")]


def test_stops_places_visitors(spark, tmp_path):
    path = lines(tmp_path, "20240102,7,20240102030405,12,1.5,110.5,20.25")
    assert rows(readers.read_csv(spark, "stop", path)) == [(day(2), "7", at("02 03:04:05"), "12", 1.5, 110.5, 20.25)]
    path = lines(tmp_path, "7,12,110.5,20.25", "8,None,None,None")
    assert rows(readers.read_csv(spark, "place", path)) == [("7", "12", 110.5, 20.25), ("8", None, None, None)]
    path = lines(tmp_path, "7,301,20240102,20240104,3")
    assert rows(readers.read_csv(spark, "visitor", path)) == [("7", 301, day(2), day(4), 3)]


@pytest.mark.parametrize("bad", ["7,20240101000000,12,110.5,20.25", "7,20240101000000,12,110.5,20.25,301,1", "7,x,12,110.5,20.25,301"])
def test_a_bad_line_fails_the_job(spark, tmp_path, bad):
    path = lines(tmp_path, "7,20240131235958,12,110.5,20.25,301", bad)
    frame = readers.read_csv(spark, "record", path)
    for wanted in (frame, frame.select("user_id", "ts")):  # also when only some columns are read
        with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST|parse"):
            wanted.collect()


def test_spots_skip_the_header(spark, tmp_path):
    path = lines(tmp_path, "id,name,status,lng,lat,cell,clng,clat,dist", "19,a,1,110,20, 77,110,20,1", "3,b,1,110,20,78,110,20,1")
    assert rows(readers.read_spots(spark, path)) == [(3, "78"), (19, "77")]


def test_bad_stations_are_dropped(spark, tmp_path):
    path = lines(
        tmp_path, "a,b,c,1,e,f,g,h,i,j,k,2500,110.5,20.5", "a,b,c,2,e,f,g,h,i,j,k,,110.5,20.5",
        "a,b,c,3,e,f,g,h,i,j,k,5,110.5", "a,b,c,4,e,f,g,h,i,j,k,5,110.5,20.5,x", "a,b,c,5,e,f,g,h,i,j,k,5,110.5,",
        "a,b,c,6,e,f,g,h,i,j,k,5,110.5,20.5,,", "a,b,c,7,e,f,g,h,i,j,k,5,None,None",
    )
    assert rows(readers.read_stations(spark, path)) == [
        ("1", 110.5, 20.5, 2500.0), ("2", 110.5, 20.5, None), ("6", 110.5, 20.5, 5.0), ("7", None, None, 5.0)
    ]


def test_calls_with_blank_ends(spark, tmp_path):
    path = lines(tmp_path, "x,20240101080000,y,1,2,60000", "x,20240101080000,y,1,,5,z", "x,20240101080000,y, ,2,5")
    assert rows(readers.read_calls(spark, path), "caller", "callee", "dur_ms") == [(None, "2", 5), ("1", None, 5), ("1", "2", 60000)]


@pytest.mark.parametrize("line", ["0,20240101000000,x,1", "", "a,b,c,d,e"])
def test_short_call_lines_fail(spark, tmp_path, line):
    with pytest.raises(Exception, match="fewer than 6 fields"):
        readers.read_calls(spark, lines(tmp_path, "x,20240101080000,y,1,2,60000", line)).collect()


@pytest.mark.parametrize("line", ["A|x|20.5|110.5|a|b|c", "A"])
def test_short_poi_lines_fail(spark, tmp_path, line):
    with pytest.raises(Exception, match="fewer than 8 fields"):
        readers.read_poi(spark, lines(tmp_path, line)).collect()


def test_equal_hotels_with_other_unused_fields_are_one(spark, tmp_path):
    tail = "|20.5|110.5|a|b|c|酒店;星级酒店|99.5|d|1|2|3|4|5|6|7|"
    path = lines(tmp_path, "A|x" + tail + "8", "A|y" + tail + "8", "A|x" + tail + "9")
    poi = readers.read_poi(spark, path)
    stations = spark.createDataFrame([("1", 110.5, 20.5, 500.0)], TABLES["base_station"])
    assert rows(lodging.cell_hotel_labels(poi, stations)) == [("1", "0|0")]  # another score is another hotel


def test_poi(spark, tmp_path):
    priced = "A|x|20.5|110.5|a|b|c|酒店;其他|99.5|d|1|2|3|4|5|6|7|8"
    path = lines(tmp_path, priced, priced, "B|x|20.5|110.5|a|b|c|购物|99.5", "C|x|20.5|110.5|a|b|c|酒店||d|1|2|3|4|5|6|7|8")
    frame = readers.read_poi(spark, path)
    assert rows(frame, "name", "tags", "lng", "lat", "price") == [
        ("A", "酒店;其他", 110.5, 20.5, 99.5), ("B", "购物", 110.5, 20.5, -1.0), ("C", "酒店", 110.5, 20.5, -1.0)
    ]
    assert frame.select("poi_id").distinct().count() == 3


def write_text(derived, root, province=PROVINCE, month=MONTH):
    """The derived tables in the raw text layouts."""
    stamp = "date_format(ts, 'yyyyMMddHHmmss')"
    known = "coalesce(cast(lng as string), 'None'), coalesce(cast(lat as string), 'None')"
    record = f"concat_ws(',', user_id, {stamp}, cell_id, {known}, prov)"
    stops = f"concat_ws(',', date_format(day, 'yyyyMMdd'), user_id, {stamp}, cell_id, dur_h, {known})"
    place = f"concat_ws(',', user_id, cell_id, {known})"
    text = {
        "visitor_record": record, "local_record": record, "visitor_stop": stops, "local_stop": stops,
        "user_home": place, "user_work": place,
        "cdr": "concat_ws(',', 'a', date_format(call_ts, 'yyyyMMddHHmmss'), 'b', caller, coalesce(string(callee), ''), dur_ms)",
        "base_station": "concat_ws(',', 'a,b,c', cell_id, 'e,f,g,h,i,j,k', coalesce(string(radius_m), ''), lng, lat)",
        "scenic_spot": "concat_ws(',', scenic_id, 'n,s,0,0', cell_id, '0,0,0')",
        # The name carries the key, so that equal hotels stay apart.
        "poi": "concat_ws('|', concat(poi_id, ' ', name), 'x', lat, lng, 'a|b|c', tags, price, 'd|1|2|3|4|5|6|7|8')",
    }
    for name, line in text.items():
        path = f"{root}/{RAW_PATHS[name].format(province=province, month=month)}"
        getattr(derived, name).select(F.expr(line)).write.mode("overwrite").text(path)


class TextCells:
    """Inputs whose cell ids are text, as in the raw files; ties go by the order of the text."""

    def __init__(self, inputs):
        self._inputs = inputs

    def __getattr__(self, name):
        table = getattr(self._inputs, name)
        return table.withColumn("cell_id", F.col("cell_id").cast("string")) if "cell_id" in table.columns else table


@pytest.fixture(scope="module")
def derived(spark):
    return TextCells(DerivedInputs(spark, "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def raw_root(spark, derived, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    write_text(derived, root)
    return root


def comparable(df):
    kept = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    return rows(df.select(*kept))


@pytest.mark.parametrize("kind", sorted(RESULTS))
def test_report_from_text_equals_the_queries(spark, derived, raw_root, tmp_path, kind):
    raw = Catalog(RawInputs(spark, raw_root, PROVINCE, MONTH), MONTH)
    folders = run_report(kind, raw, str(tmp_path), PROVINCE, MONTH)
    catalog = Catalog(derived, MONTH)
    names = [*(TOURIST_BASE.values() if kind == "tourist" else []), *RESULTS[kind]]
    assert len(folders) == len(names) == {"tourist": 21, "resident": 1, "routes": 1}[kind]
    for name, folder in zip(names, folders):
        assert folder.endswith(f"{name}/province={PROVINCE}/month={MONTH}")
        assert comparable(spark.read.parquet(folder)) == comparable(getattr(catalog, name)()), name


def test_text_results(spark, derived, tmp_path):
    catalog = Catalog(derived, MONTH)
    (folder,) = run_report("routes", catalog, str(tmp_path), PROVINCE, MONTH, fmt="csv")
    assert spark.read.text(folder).count() == catalog.representative_route().count()
    with pytest.raises(ValueError):
        run_report("routes", catalog, str(tmp_path), PROVINCE, MONTH, fmt="xml")


def test_parquet_inputs_prune_partitions(spark, derived, tmp_path):
    for name in TABLES:
        table = getattr(derived, name)
        for province in (PROVINCE, "GuangDong"):
            part = f"{tmp_path}/{name}/province={province}/month={MONTH}"
            (table if province == PROVINCE else table.limit(1)).write.parquet(part)
    inputs = ParquetInputs(spark, str(tmp_path), PROVINCE, MONTH)
    assert inputs.visitor_record.count() == derived.visitor_record.count()
    plan = inputs.visitor_record._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(province" in plan
    assert comparable(Catalog(inputs, MONTH).visitor_detect()) == comparable(Catalog(derived, MONTH).visitor_detect())
    with pytest.raises(AttributeError):
        inputs.nothing


def test_stored_tables_are_dropped_by_their_paths(spark):
    from wanderlens.sources.stored import drop_stored, shared_folder, stored

    kept = f"{shared_folder(spark)}/kept"
    spark.range(3).write.mode("overwrite").parquet(kept)
    frame = stored(spark.range(5))
    assert frame.count() == 5
    assert drop_stored(spark) >= 1 and drop_stored(spark) == 0
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(frame.inputFiles()[0]).count()


def test_many_provinces_and_months_in_one_run(spark, derived, tmp_path):
    """Raw text of two provinces and two months goes to typed partitions, and the report of all to one table."""
    raw, lake, out = (str(tmp_path / d) for d in ("raw", "lake", "out"))
    shares = {("HaiNan", "202401"): "true", ("HaiNan", "202402"): "false", ("GuangDong", "202401"): "user_id < 'u5'", ("GuangDong", "202402"): "false"}
    for (province, month), share in shares.items():
        some = {n: getattr(derived, n) for n in RAW_PATHS}
        some = {n: t.filter(share) if "user_id" in t.columns else t for n, t in some.items()}
        write_text(type("Part", (), some), raw, province, month)
    provinces, months = ["HaiNan", "GuangDong"], ["202401", "202402"]
    folders = import_raw(spark, raw, lake, provinces, months)
    assert len(folders) == len(set(folders)) == 7 * 4 + 3 * 2
    for province in provinces:
        inputs = ParquetInputs(spark, lake, province, "202401")
        for name in RAW_PATHS:
            if name != "poi":
                text = getattr(RawInputs(spark, raw, province, "202401"), name)
                assert comparable(getattr(inputs, name).select(text.columns)) == comparable(text), name
    # A second import of one month leaves the others alone, and an empty one replaces what was there.
    before = spark.read.parquet(f"{lake}/local_stop").count()
    empty = spark.createDataFrame([], "value string")
    empty.write.mode("overwrite").text(f"{raw}/{RAW_PATHS['local_stop'].format(province='GuangDong', month='202401')}")
    import_raw(spark, raw, lake, ["GuangDong"], ["202401"])
    assert ParquetInputs(spark, lake, "GuangDong", "202401").local_stop.count() == 0
    assert spark.read.parquet(f"{lake}/local_stop").count() == ParquetInputs(spark, lake, "HaiNan", "202401").local_stop.count() < before
    catalogs = {(p, m): Catalog(ParquetInputs(spark, lake, p, m), m) for p in provinces for m in months}
    folders = run_reports("routes", catalogs, out)
    assert len(folders) == 4
    whole = spark.read.parquet(f"{out}/representative_route")
    own = catalogs["HaiNan", "202401"].representative_route()
    assert comparable(whole.filter("province = 'HaiNan' and month = 202401").drop("province", "month")) == comparable(own)
    assert whole.select("province", "month").distinct().count() == 1
    assert all(spark.read.parquet(f).columns == own.columns for f in folders)


def test_a_filter_on_partitions_leaves_one_part_in_the_plan(spark, derived):
    parts = {(p, m): derived.user_home for p in ("A", "B") for m in ("202401", "202402")}
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    table = in_partitions(parts, ["province", "month"])
    assert scans(table) == 4 * scans(derived.user_home)
    assert scans(table.filter("province = 'B' and month = '202402'")) == scans(derived.user_home)
