"""The published merge scenarios, as rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import replicas as R

T = dt.datetime(2026, 8, 14, 10, 0, 0)
PILES = "collection_id string, key string, condition string, quantity bigint, updated_at timestamp"
MARKS = "collection_id string, k string, removed_at timestamp"


def ms(n):
    return T + dt.timedelta(milliseconds=n)


def rows(case, quantity, at=0, condition="NM"):
    return [] if quantity is None else [(case, "k", condition, quantity, ms(at))]


SCENARIOS = {  # case: (mine, theirs, base, tombstone, expected quantity)
    "1": (rows("1", 3), rows("1", 2), [], None, 5),
    "2": (rows("2", 3), rows("2", 3), rows("2", 3), None, 3),
    "3": (rows("3", 5), rows("3", 2), rows("3", 2), None, 5),
    "4": (rows("4", 1), rows("4", 6), rows("4", 4), None, 3),
    "5": ([], [], rows("5", 2), None, 0),
    "6": ([], rows("6", 3), rows("6", 3), None, 0),
    "7": ([], rows("7", 3), [], 5000, 0),
    "7b": ([], rows("7b", 3), [], None, 3),
    "8": (rows("8", 1, 9000), [], [], 5000, 1),
    "9": (rows("9", 1, 1000, "LP"), rows("9", 1, 2000, "MP"), rows("9", 1), None, 1),
    "tie": (rows("tie", 1, 0, "LP"), rows("tie", 1, 0, "MP"), [], None, 2),
}


def test_scenarios(spark):
    pick = lambda i: spark.createDataFrame([r for s in SCENARIOS.values() for r in s[i]], PILES)
    marks = spark.createDataFrame([(c, "k", ms(s[3])) for c, s in SCENARIOS.items() if s[3] is not None], MARKS)
    got = {r.collection_id: r for r in R.merge_replicas(pick(0), pick(1), pick(2), marks).collect()}
    for case, scenario in SCENARIOS.items():
        assert (got[case].quantity if case in got else 0) == scenario[4], case
    assert got["9"].condition == "MP" and got["tie"].condition == "LP"


def test_zero_tombstone_is_ignored(spark):
    mine = spark.createDataFrame(rows("c", 2), PILES)
    empty = spark.createDataFrame([], PILES)
    marks = spark.createDataFrame([("c", "k", dt.datetime(1970, 1, 1))], MARKS)
    assert R.merge_replicas(mine, empty, empty, marks).count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_quantities_commute_and_idempotence(spark, seed):
    rng = np.random.default_rng(seed)

    def random_side():
        keys = rng.choice(200, 120, replace=False)
        return spark.createDataFrame(
            [("c", f"k{k}", "NM", int(rng.integers(1, 9)), ms(int(rng.integers(0, 99)))) for k in keys], PILES)

    a, b, base = random_side(), random_side(), random_side()
    marks = spark.createDataFrame([("c", f"k{k}", ms(50)) for k in range(0, 200, 9)], MARKS)
    one = {r.key: r.quantity for r in R.merge_replicas(a, b, base, marks).collect()}
    two = {r.key: r.quantity for r in R.merge_replicas(b, a, base, marks).collect()}
    assert one == two and one
    merged = R.merge_replicas(a, b, base, marks)
    again = {r.key: r.quantity for r in R.merge_replicas(merged, merged, merged, marks).collect()}
    assert again == one


def test_wants_history_tombstones(spark):
    want = "collection_id string, card_id string, unit_price double, added_at timestamp"
    a = spark.createDataFrame([("c", "x", 1.0, ms(5)), ("c", "y", 1.0, ms(5)), ("c", "z", 1.0, ms(1))], want)
    b = spark.createDataFrame([("c", "x", 2.0, ms(5)), ("c", "y", 2.0, ms(6))], want)
    marks = spark.createDataFrame([("c", "z", ms(1))], MARKS)
    got = {r.card_id: r.unit_price for r in R.merge_wants(a, b, marks).collect()}
    assert got == {"x": 1.0, "y": 2.0}
    point = "collection_id string, day date, value double, cards bigint"
    d = lambda n: dt.date(2026, 8, n)
    h = R.merge_history(
        spark.createDataFrame([("c", d(1), 100.0, 1), ("c", d(2), 120.0, 1)], point), spark.createDataFrame([("c", d(1), 400.0, 2)], point))
    assert [(r.value, r.cards) for r in h.orderBy("day").collect()] == [(400.0, 2), (120.0, 1)]
    older = R.merge_tombstones(
        spark.createDataFrame([("c", "k", ms(9))], MARKS), spark.createDataFrame([("c", "k", ms(3))], MARKS), ["collection_id"])
    assert older.first().removed_at == ms(3)
    assert R.sweep_tombstones(older, F.lit(ms(3))).count() == 0


def test_a_failed_publication_leaves_state_and_base(spark, tmp_path):
    root, broken = str(tmp_path), F.raise_error(F.lit("lost"))
    state = lambda n, wants=None: {
        "piles": spark.createDataFrame([("a", n)], "collection_id string, quantity long"),
        "wants": spark.createDataFrame([("a", n)], "collection_id string, card_id long").withColumn("card_id", F.col("card_id") if wants is None else wants)}
    seen = lambda which: {name: [r[1] for r in df.collect()] for name, df in R.published(spark, root, which).items()}
    assert seen("live") == seen("base") == {}
    R.publish(state(1), root, "01")
    assert seen("live") == seen("base") == {"piles": [1], "wants": [1]}
    with pytest.raises(Exception, match="lost"):  # between two tables
        R.publish(state(2, broken.cast("bigint")), root, "02")
    assert seen("live") == seen("base") == {"piles": [1], "wants": [1]}

    def push(tables):
        raise ConnectionError("not pushed")

    with pytest.raises(ConnectionError):  # the base waits for the push
        R.publish(state(2), root, "02", push)
    assert seen("live") == {"piles": [2], "wants": [2]} and seen("base") == {"piles": [1], "wants": [1]}
    pushed = []
    R.publish(state(2), root, "02", lambda tables: pushed.append(sorted(tables)))
    assert seen("live") == seen("base") == {"piles": [2], "wants": [2]} and pushed == [["piles", "wants"]]
    assert [p.name for p in (tmp_path / "versions").iterdir()] == ["02"]
