"""Every registered query of the library against its SQL, on the smallest driver tables."""

import duckdb
import pandas as pd
import pytest

from tidewell.plans import queries as plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
APART = {"two_stage"}  # has a test of its own below


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df)].copy()
    for c in df:
        if str(df[c].dtype).startswith("datetime") or df[c].dtype == object and hasattr(next(iter(df[c].dropna()), ""), "isoformat"):
            df[c] = pd.to_datetime(df[c]).astype(str)
        elif df[c].dtype == object or df[c].dtype == bool:
            df[c] = df[c].astype(str)
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    ours, theirs = normal(plans.QUERIES[name](spark, DIR).toPandas()), normal(duck.execute(plans.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, rtol=1e-9, atol=1.1e-4)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL) - APART))
def test_has_rows(spark, name):
    assert plans.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pivot_of_every_location(spark):
    panel = plans.weekly_panel(spark, DIR)
    rows = plans.QUERIES["pivot_unpivot_all"](spark, DIR)
    keys = ["location", "date", "y"]
    assert rows.where("y is not null").select(keys).exceptAll(panel.select(keys)).count() == 0
    assert rows.where("y is not null").count() == panel.count() and rows.select("location").distinct().count() == spark.read.parquet(f"{DIR}/nation.parquet").count()


def test_two_stage_has_every_horizon(spark):
    rows = plans.QUERIES["two_stage"](spark, DIR).select("location", "reference_date", "h", "mu", "sigma").toPandas()
    anchors = plans.filled(spark, DIR).where("date >= '1999-06-05'").count()
    assert rows.groupby("h").size().to_dict() == dict.fromkeys((1, 2, 3, 4), anchors)
    assert not rows.duplicated(["location", "reference_date", "h"]).any() and rows.mu.notna().all() and (rows.sigma > 0).all()
