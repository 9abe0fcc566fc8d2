"""Sources that no query reaches."""

from tidewell.operators import select
from tidewell.sources import tables


def test_latest_file(spark, tmp_path):
    for name, v in (("panel_2024-01-06.csv", 1), ("panel_20240113.csv", 2), ("panel_2023-12-30.csv", 3), ("notes.csv", 4)):
        (tmp_path / name).write_text(f"v\n{v}\n")
    rows = tables.latest_file(spark.read.option("header", True).csv(str(tmp_path / "*.csv")))
    assert [r.v for r in rows.collect()] == ["2"]


def test_rows_without_location_stay(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "location string")
    assert {r.location for r in select.exclude_locations(rows, ["a"]).collect()} == {"b", None}


def test_stored_tables_are_read_again(spark):
    df = spark.range(5).selectExpr("id", "array(id) AS a")
    got = tables.stored(df, "t")
    assert got.dtypes == df.dtypes and got.count() == 5 and "Scan parquet" in got._jdf.queryExecution().toString()
