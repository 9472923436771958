"""Every registered query of the library against its SQL, and those without SQL against properties."""

import math
import os

import duckdb
import pytest

from tessera import plans

from .conftest import SMALL

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SMALL}/{name}'")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0) if value else "0.0"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, oracle, name):
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = oracle.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_codec_round_trip(spark):
    assert {r.same for r in QUERIES["npy_codec"](spark, SMALL).collect()} == {True}


def test_regrade_reaches_slope(spark):
    for r in QUERIES["spectral_regrade"](spark, SMALL).collect():
        assert abs(r.alpha_after - 1.49) < 0.2


def test_blurs_flatten(spark):
    for r in QUERIES["median_blur"](spark, SMALL).collect():
        assert r.std_after < r.std_before
    for r in QUERIES["directional_blur"](spark, SMALL).collect():
        assert max(r.std_rows, r.std_columns) < r.std_before


def test_conditions_of_an_item_share_geometry(spark):
    rows = QUERIES["build_bag"](spark, SMALL).collect()
    places = {}
    for r in rows:
        places.setdefault((r.stem, r.crop), set()).add((r.y, r.x))
    assert all(len(p) == 1 for p in places.values())


def test_memberships_sum_to_one(spark):
    from tessera.functions.colour import CATEGORIES

    for r in QUERIES["colour_names_soft"](spark, SMALL).limit(500).collect():
        assert abs(sum(r[f"m_{c}"] for c in CATEGORIES) - 1) < 1e-4


def test_stream_balancer_counts_all_events(spark):
    rows = QUERIES["stream_balancer"](spark, SMALL).collect()
    assert sum(r.epochs for r in rows) == spark.read.parquet(f"{SMALL}/events.parquet").count()
