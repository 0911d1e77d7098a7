"""Every registered query runs; where there is an oracle, values agree."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
# Their constants must hold at every scale: results that are not trivial there.
SCALES = ["j2_verified_match", "j3_attach_products", "v3_match_report", "a10_join_coverage", "u5_member_overlap"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SCALES)
def test_oracle_at_a_larger_scale(spark, name):
    ok, message = compare(spark, LARGER, QUERIES[name], ORACLES[name])
    assert ok, message


def test_the_book_is_published_at_a_larger_scale(spark):
    rows = connect(LARGER).execute(f"SELECT count(*) FROM ({ORACLES['p4_refresh_prices']})").fetchone()[0]
    assert QUERIES["p4_refresh_prices"](spark, LARGER).count() == rows > 100_000


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", LARGER])
def test_matching_accepts_and_rejects_at_every_scale(spark, sf):
    report = QUERIES["j2_verified_match"](spark, sf).collect()
    assert sorted(r.set_id for r in report if not r.accepted) == ["Brand#15", "Brand#25", "Brand#6", "Brand#7", "Brand#8", "Brand#9"]
    products = QUERIES["j3_attach_products"](spark, sf)
    assert products.filter("product_id is not null").count() > 0.4 * products.count()
    assert QUERIES["p1_build_catalogue"](spark, sf).filter("product_id is not null").count() > 100


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    ok, message = compare(spark, SF, QUERIES[name], ORACLES[name], con, allow_empty=True)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
