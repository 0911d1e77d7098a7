"""Ledger replay against a plain loop and against the set-based operators."""

import datetime as dt
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import book as P
from vitrine.operators import piles as L
from vitrine.streaming import ledger as G

LOG = ("collection_id string, seq bigint, at bigint, op string, card_id bigint, name string, variant string, condition string, "
       "quantity bigint, unit_price double, new_card_id bigint, new_name string, new_variant string, new_condition string, new_grader string, new_score double")

MOVES = LOG + ", to_collection string"


class Row:
    grader = score = needs_printing = to_collection = None

    def __init__(self, values):
        self.__dict__.update(values)


def random_log(seed, n=1500, crossing=True):
    rng = np.random.default_rng(seed)
    names = ["Ant", "Bee (a)", "Bee (b)", "Cat"]
    rows = []
    for i in range(n):
        card = 1 if rng.random() < 0.4 else int(rng.integers(0, 8))
        op = str(rng.choice(["add", "set", "undo", "regrade", "reclassify", "repoint"], p=[0.6, 0.08, 0.1, 0.08, 0.08, 0.06]))
        to = int(rng.integers(0, 8)) if crossing else card
        rows.append((
            f"c{rng.integers(0, 3)}", i, 1000 + i, op, card, names[card % 4], str(rng.choice(["N", "H"])), str(rng.choice(["NM", "LP"])),
            int(rng.integers(0, 4)) if op == "set" else int(rng.integers(1, 4)), None if rng.random() < 0.3 else float(rng.integers(1, 90)), to, names[to % 4],
            "N" if op == "repoint" or rng.random() < 0.5 else None, None if rng.random() < 0.5 else "LP",
            None if rng.random() < 0.3 else "PSA", 9.0))
    return [r[:14] + (r[14], r[15] if r[14] else None) for r in rows]


def loop(rows):
    names = [x.split()[0] for x in MOVES.split(", ")]
    state = G.Ledger()
    for r in rows:
        state.step(Row(dict(zip(names, r))))
    return sorted(state.rows())


def piles_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("crossing", [True, False])
def test_replay_equals_loop(spark, crossing):
    rows = random_log(3, crossing=crossing)
    got = piles_of(G.replay_log(spark.createDataFrame(rows, LOG), F.floor(F.col("seq") / 100)))
    assert [g[:2] + g[8:9] + g[11:] for g in got] == [w[:2] + w[8:9] + w[11:] for w in loop(rows)]
    assert [g[9] for g in got] == [w[9] for w in loop(rows)]


def test_stream_in_batches_equals_loop(spark, tmp_path):
    rows = random_log(5, 600)
    schema = spark.createDataFrame(rows, LOG).withColumn("ts", F.timestamp_millis("at")).withColumn("event_id", F.col("seq"))
    path = str(tmp_path / "log")
    for low in (0, 200, 400):
        part = schema.filter((F.col("seq") >= low) & (F.col("seq") < low + 200))
        # a repeated event id must not count again
        part.unionByName(part.limit(5)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema.schema).option("maxFilesPerTrigger", 1).parquet(path)
    state = str(tmp_path / "state")
    writer = G.ledger_stream(stream, state, F.floor(F.col("seq") / 100))
    writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = piles_of(G.read_ledger(spark, state))
    assert [g[:2] + g[8:10] for g in got] == [w[:2] + w[8:10] for w in loop(rows)]


PILE = ("collection_id string, key string, card_id bigint, variant string, condition string, grader string, score double, quantity bigint, "
        "unit_price double, added_at timestamp, updated_at timestamp, needs_printing boolean")
T0 = dt.datetime(2026, 8, 14)


def pile(key, quantity, collection="a", price=2.0):
    card, variant, condition = key.split("|")[:3]
    return (collection, key, int(card), variant, condition, None, None, quantity, price, T0, T0, True)


def test_moves_conserve_and_refuse(spark):
    piles = spark.createDataFrame([pile("1|N|NM", 5), pile("1|N|NM", 2, "b"), pile("2|N|NM", 1)], PILE)
    moves = spark.createDataFrame(
        [("a", "b", "1|N|NM", 9, T0), ("a", "a", "2|N|NM", 1, T0), ("a", "nowhere", "2|N|NM", 1, T0), ("b", "a", "9|N|NM", 1, T0)],
        "from_id string, to_id string, key string, n bigint, moved_at timestamp")
    got = {(r.collection_id, r.key): r.quantity for r in L.move_between(piles, moves).collect()}
    assert got == {("b", "1|N|NM"): 7, ("a", "2|N|NM"): 1}


def test_collisions_merge(spark):
    piles = spark.createDataFrame([pile("1|N|NM", 5, price=3.0), pile("1|N|LP", 2), pile("2|N|NM", 1)], PILE)
    ch = spark.createDataFrame([("a", "1|N|LP", None, "NM", 9.0, True, T0)],
                               "collection_id string, key string, new_variant string, new_condition string, new_price double, set_price boolean, changed_at timestamp")
    got = {r.key: (r.quantity, r.unit_price, r.needs_printing) for r in L.reclassify(piles, ch).collect()}
    assert got == {"1|N|NM": (7, 9.0, True), "2|N|NM": (1, 2.0, True)}
    grade = spark.createDataFrame([("a", "2|N|NM", "PSA", 10.0, T0)], "collection_id string, key string, grader string, score double, changed_at timestamp")
    assert {r.key for r in L.regrade(piles, grade).collect()} == {"1|N|NM", "1|N|LP", "2|N|NM|PSA10"}


def test_default_printing(spark):
    rows = [(1, "Holofoil", 5.0), (1, "Normal", 9.0), (2, "Reverse", 4.0), (2, "Cosmos", 3.0), (3, "Normal", None), (3, "Holofoil", 8.0), (4, "B", None), (4, "A", None)]
    df = spark.createDataFrame(rows, "card_id int, variant string, market double")
    got = {r.card_id: (r.variant, r.price) for r in P.default_printing(df).collect()}
    assert got == {1: ("Normal", 9.0), 2: ("Cosmos", 3.0), 3: ("Holofoil", 8.0), 4: ("A", None)}


def test_reprice_touches_only_the_price(spark):
    piles = spark.createDataFrame([pile("1|N|NM", 5), pile("2|N|NM", 1)], PILE)
    book = spark.createDataFrame([(1, "N", 2.5), (2, "N", None)], "card_id bigint, variant string, market double")
    got = {r.key: r for r in L.reprice_piles(piles, book).collect()}
    assert (got["1|N|NM"].unit_price, got["1|N|NM"].changed, got["1|N|NM"].updated_at) == (2.5, True, T0)
    assert (got["2|N|NM"].unit_price, got["2|N|NM"].changed) == (2.0, False)


def test_library_commands(spark):
    rows = [(1, 0, "add", "x", " My  cards ", 1), (1, 1, "add", "y", "", 2), (1, 2, "rename", "x", " ", 3), (1, 3, "remove", "y", None, 4),
            (1, 4, "remove", "x", None, 5), (1, 5, "activate", "zz", None, 6)]
    df = spark.createDataFrame(rows, "owner bigint, seq bigint, op string, collection_id string, name string, at bigint")
    got = G.manage_collections(df).collect()
    assert [(r.collection_id, r.name, r.active) for r in got] == [("x", "My cards", True)]


def test_versions_stay_few_and_equal_a_loop(spark, tmp_path, monkeypatch):
    """Many small batches: the same piles as one loop, changed piles only in a part, parts as digits of the number."""
    monkeypatch.setattr(G, "PARTS", 2)
    rows = random_log(9, 220)
    state = str(tmp_path / "state")
    for i in range(5):
        lines = G.complete_log(spark.createDataFrame(rows[44 * i:44 * i + 44], LOG))
        G.apply_batch(lines, state, f"{i:03d}", F.floor(F.col("seq") / 100))
        parts = G.Commits(spark, f"{state}/commits").read(f"{i:03d}")["parts"]
        digits = np.base_repr(i + 1, 2)
        assert len(parts) == sum(map(int, digits)) and [p[1] for p in parts] == sorted((p[1] for p in parts), reverse=True)
    got = piles_of(G.read_ledger(spark, state))
    assert [g[:2] + g[8:10] for g in got] == [w[:2] + w[8:10] for w in loop(rows)]
    assert len(G.Commits(spark, f"{state}/commits").folders(f"{state}/parts")) <= 6


@pytest.mark.parametrize("step", ["_write_part", "write"])
def test_a_killed_batch_repeats_cleanly(spark, tmp_path, monkeypatch, step):
    rows = random_log(13, 60)
    state, at = str(tmp_path / "state"), F.floor(F.col("seq") / 100)
    part = lambda i: G.complete_log(spark.createDataFrame(rows[20 * i:20 * i + 20], LOG))
    G.apply_batch(part(0), state, "000", at)
    before = piles_of(G.read_ledger(spark, state))

    def fail(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="killed"):
        patch.setattr(*((G, step, fail) if step == "_write_part" else (G.Commits, step, fail)))
        G.apply_batch(part(1), state, "001", at)
    assert piles_of(G.read_ledger(spark, state)) == before
    for number, i in (("001", 1), ("001", 1), ("002", 2), ("001", 1)):
        G.apply_batch(part(i), state, number, at)
    got = piles_of(G.read_ledger(spark, state))
    assert [g[:2] + g[8:10] for g in got] == [w[:2] + w[8:10] for w in loop(rows)]


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    state, at = str(tmp_path / "state"), F.floor(F.col("seq") / 100)
    line = lambda seq, card, n: ("a", seq, seq, "add", card, f"Name {card}", "N", "NM", n, 1.0, None, None, None, None, None, None)
    G.apply_batch(G.complete_log(spark.createDataFrame([line(i, i, 1) for i in range(50)], LOG)), state, "000", at)
    G.apply_batch(G.complete_log(spark.createDataFrame([line(60, 7, 2)], LOG)), state, "001", at)
    stored = spark.read.parquet(f"{state}/parts/001").collect()
    assert [(r.card_id, r.quantity, r.gone) for r in stored] == [(7, 3, False)]
    assert G.read_ledger(spark, state).count() == 50


def moving_log(seed, n):
    """Ten names; moves, redirects and repoints stay among names 0-3 or among 4-6, the rest never meets another shelf."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        op = str(rng.choice(["add", "set", "undo", "reclassify", "repoint", "move", "redirect"], p=[0.5, 0.06, 0.1, 0.08, 0.06, 0.12, 0.08]))
        card = int(rng.integers(0, 7 if op in ("repoint", "move", "redirect") else 10))
        to = int(rng.integers(0, 4) if card < 4 else rng.integers(4, 7))
        where = f"c{rng.integers(0, 3)}"
        rows.append((
            where, i, 1000 + i, op, card, f"Name {card}", str(rng.choice(["N", "H"])), "NM", int(rng.integers(0, 4)) if op in ("set", "move") else 1 + int(rng.integers(0, 3)),
            None if rng.random() < 0.3 else float(rng.integers(1, 90)), None if op == "redirect" and rng.random() < 0.1 else to, f"Name {to}",
            "N" if op == "repoint" or rng.random() < 0.7 else None, None, None, None, None if rng.random() < 0.1 else f"c{rng.integers(0, 3)}"))
    return rows


def test_moves_and_redirects_equal_a_loop(spark):
    rows = moving_log(21, 1500)
    log = spark.createDataFrame(rows, MOVES)
    assert piles_of(G.replay_log(log, F.floor(F.col("seq") / 100))) == loop(rows)
    units = G._units(G.complete_log(log)).select("_unit", "collection_id", "name").distinct().toPandas()
    names = units.groupby("_unit")["name"].agg(set)
    assert len(names) >= 9 + 2 and all(len(n) == 1 or n <= {f"Name {i}" for i in range(4)} or n <= {f"Name {i}" for i in range(4, 7)} for n in names)
    assert units[units["name"].isin({"Name 7", "Name 8", "Name 9"})].groupby("_unit").size().max() == 1


def test_moves_between_stored_piles_equal_a_loop(spark, tmp_path):
    rows = moving_log(22, 160)
    for i in range(4):
        G.apply_batch(G.complete_log(spark.createDataFrame(rows[40 * i:40 * i + 40], MOVES)), str(tmp_path), f"{i:03d}", F.floor(F.col("seq") / 100))
    assert piles_of(G.read_ledger(spark, str(tmp_path))) == loop(rows)


def test_a_move_and_a_redirect_by_hand(spark):
    line = lambda seq, op, n, card=1, where="a", **more: Row({
        "collection_id": where, "seq": seq, "at": seq, "op": op, "card_id": card, "name": f"Name {card}", "variant": "N", "condition": "NM", "quantity": n,
        "unit_price": None, "new_card_id": None, "new_name": None, "new_variant": None, "new_condition": None, "new_grader": None, "new_score": None} | more)
    lines = [line(1, "add", 5, unit_price=2.0), line(2, "add", 1, where="b", unit_price=7.0), line(3, "move", 3, to_collection="b"), line(4, "move", 9, to_collection="a"),
             line(5, "redirect", None, new_card_id=8, new_name="Name 8", new_variant="H", unit_price=4.0), line(6, "redirect", None, new_card_id=None),
             line(7, "redirect", None, card=3, new_card_id=9, new_name="Name 9"), line(8, "move", 9, to_collection="c")]
    names = [x.split()[0] for x in MOVES.split(", ")]
    log = spark.createDataFrame([tuple(getattr(x, n) for n in names) for x in lines], MOVES)
    got = {(r.collection_id, r.key): (r.quantity, r.unit_price, r.updated_at) for r in G.replay_log(log, F.lit(0)).collect()}
    assert got == {("b", "1|N|NM"): (4, 7.0, 3), ("a", "8|H|NM"): (1, 4.0, 5), ("a", "9|Normal|NM"): (1, None, 7), ("c", "1|N|NM"): (1, 2.0, 8)}


def test_components_of_chains_stars_and_nothing(spark):
    from vitrine.operators.components import components

    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z", f"x{i}") for i in range(50)] + [("q", "q"), ("q", None), ("z", "x1")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and {got["z"], *(got[f"x{i}"] for i in range(50))} == {"x0"} and got["q"] == "q"
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_crowded_units_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(G, "CROWD", 150)
    rows = moving_log(23, 900)
    assert piles_of(G.replay_log(spark.createDataFrame(rows, MOVES), F.floor(F.col("seq") / 100))) == loop(rows)


def test_lines_of_small_units_are_shuffled_once(spark):
    rows = random_log(4, 300, crossing=False)
    out = G.replay_log(spark.createDataFrame([r for r in rows if r[3] != "repoint"], LOG), F.floor(F.col("seq") / 100))
    assert out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Window" not in plan and plan.count("Exchange hashpartitioning(_unit") == 1


def test_rekey_needs_no_more_columns_than_the_caller_keeps(spark):
    """Piles without names and dates of adding: a regraded pile merges into the one of its new key."""
    piles = spark.createDataFrame(
        [("a", "1|N|NM", 1, "N", "NM", None, None, 2, 3.0, dt.datetime(2024, 1, 1), False), ("a", "1|N|NM|CGC9", 1, "N", "NM", "CGC", 9.0, 5, 4.0, dt.datetime(2024, 1, 2), True)],
        "collection_id string, key string, card_id bigint, variant string, condition string, grader string, score double, quantity bigint, unit_price double, "
        "updated_at timestamp, needs_printing boolean")
    changes = spark.createDataFrame([("a", "1|N|NM", "CGC", 9.0, dt.datetime(2024, 2, 1))], "collection_id string, key string, grader string, score double, changed_at timestamp")
    (row,) = L.regrade(piles, changes).collect()
    assert (row.key, row.quantity, row.unit_price, row.updated_at, row.needs_printing) == ("1|N|NM|CGC9", 7, 3.0, dt.datetime(2024, 2, 1), False)


def test_narrow_piles_are_the_settled_ones(spark, sf_dir):
    from vitrine.bindings import ledger as B

    narrow = B.narrow(spark, sf_dir, "added_at")
    assert not {"name", "rarity"} & set(narrow.columns) and "added_at" not in B.narrow(spark, sf_dir).columns
    settled = B.settled(spark, sf_dir).select(*narrow.columns)
    assert narrow.exceptAll(settled).isEmpty() and settled.exceptAll(narrow).isEmpty()


def test_lines_of_joined_shelves_share_one_exchange(spark, monkeypatch):
    """Lines go to their shelf once, and on to their unit only where shelves are joined; the rows are those of the loop."""
    monkeypatch.setattr(G, "CROWD", 10_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = moving_log(24, 600)
        out = G.replay_log(spark.createDataFrame(rows, MOVES), F.floor(F.col("seq") / 100))
        assert piles_of(out) == loop(rows)
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [x for x in plan.splitlines() if "REPARTITION_BY_COL" in x]
    assert sorted("ReusedExchange" in x for x in wide if "_shelf" in x) == [False, True] and sum("hashpartitioning(_unit" in x for x in wide) == 1


def test_lines_keep_what_their_operation_reads(spark):
    line = spark.createDataFrame([(op, "n", 2, 3.0, "H", "b") for op in ("add", "move", "regrade")], "op string, name string, quantity int, unit_price double, new_variant string, to_collection string")
    assert [tuple(r) for r in G.slim_log(line).collect()] == [
        ("add", "n", 2, 3.0, None, None), ("move", None, 2, None, None, "b"), ("regrade", None, None, None, None, None)]


def test_steps_are_removed_when_nothing_reads_them(spark):
    from vitrine.session import discard, settle

    kept, gone = settle(spark.range(3)), settle(spark.range(4))
    files = [x.removeprefix("file:").replace("//", "/") for x in gone.inputFiles()]
    discard(gone)
    assert kept.count() == 3 and files and not any(os.path.exists(x) for x in files)


def test_changes_are_what_differs_from_the_loaded_piles(spark):
    """One pile grows, one goes, one stays as it was, one comes back to what it was but for its date, one is new."""
    line = lambda op, card, n, seq, seed=None: ("a", seq, 10 * seq, op, card, f"Name {card}", "N", "NM", n, 2.0, seed)
    log = [line("load", i, 3, 0, True) for i in (1, 2, 3, 4)] + [
        line("add", 1, 2, 1), line("set", 2, 0, 2), line("add", 4, 1, 3), line("undo", 4, None, 4), line("add", 5, 1, 5)]
    rows = spark.createDataFrame(log, "collection_id string, seq bigint, at bigint, op string, card_id bigint, name string, variant string, condition string, "
                                 "quantity bigint, unit_price double, seed boolean")
    got = G.replay_log(rows, F.lit(0), changes=True)
    assert sorted((r.card_id, r.quantity, r.updated_at, r.gone) for r in got.collect()) == [(1, 5, 10, False), (2, 3, 0, True), (4, 3, 40, False), (5, 1, 50, False)]


def test_replayed_and_applied_lines_leave_no_steps(spark, tmp_path, monkeypatch):
    from vitrine import session
    from vitrine.streaming import sessions as SE

    number = itertools.count()
    monkeypatch.setattr(session, "shared_path", lambda spark, name: str(tmp_path / "steps" / f"{name}-{next(number)}"))
    log = spark.createDataFrame(random_log(5, 200), LOG).withColumns({"event_id": F.col("seq"), "ts": F.timestamp_seconds(F.col("seq") + 10**6)})
    stream = SE.replay_in_order(log, str(tmp_path / "log"), "event_id", "seq")
    assert list((tmp_path / "steps").glob("*")) == []
    writer = G.ledger_stream(stream, str(tmp_path / "state"), F.floor(F.col("seq") / 100))
    writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert piles_of(G.read_ledger(spark, str(tmp_path / "state"))) == loop(random_log(5, 200))
    lines = [x for x in (tmp_path / "steps").glob("*") if "op" in spark.read.parquet(str(x)).columns]
    assert lines == []
