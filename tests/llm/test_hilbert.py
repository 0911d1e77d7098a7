import zlib

import pytest

from tests.llm.frames import ODD, documents, words
from vitrine.llm import hilbert


def test_neighbours_on_the_curve_are_neighbours_in_space():
    places = hilbert.curve_table(3, 3)
    assert sorted(places) == list(range(512))
    cell = {p: (i // 64, i // 8 % 8, i % 8) for i, p in enumerate(places)}
    for p in range(511):
        assert sum(abs(a - b) for a, b in zip(cell[p], cell[p + 1])) == 1


def rows():
    langs = ["en", "de", None, "fr"]
    out = [(i, words(i, 3 + i % 50), langs[i % 4]) for i in range(150)]
    return out + [(500 + i, "the same text", "en") for i in range(80)] + ODD + [(7, words(7, 10), "fr")] * 2


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_law_and_slots(spark, law):
    given = rows()
    got = hilbert.places(documents(spark, given), law).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(
        ((g[0], len((g[1] or "").encode()) + 1, zlib.crc32((g[1] or "").encode())) for g in given), key=str)
    shards = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(slots == list(range(len(slots))) for slots in shards.values())
    assert all(r.law == law and r.grown_shard is None for r in got)
    # Shards are runs of the curve.
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    if law == "rows":
        assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    else:
        sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
        assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)


def test_cells_are_the_quantiles_of_a_plain_computation(spark):
    given = [(i, "x" * i, "a") for i in range(64)]
    got = {r.doc_id: r.curve for r in hilbert.places(documents(spark, given), bits=2).collect()}
    cell = lambda i: sum(i + 1 > cut for cut in (16, 32, 48))  # noqa: E731  sizes 1 to 64
    assert got == {i: hilbert.curve_place((0, 0, cell(i)), 2) for i in range(64)}


def test_few_rows_and_none(spark):
    got = hilbert.places(documents(spark, [(1, "a"), (2, None)])).collect()
    assert sorted(r.slot for r in got) == [0, 0]
    assert hilbert.places(documents(spark, [])).count() == 0


def test_written_shards_hold_every_row_once(spark, tmp_path):
    docs = documents(spark, rows()).drop("part")
    hilbert.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert sorted((str(r.doc_id), str(r.text)) for r in back.collect()) == sorted((str(r.doc_id), str(r.text)) for r in docs.collect())


def test_texts_are_cut_by_their_whole(spark):
    """Sources with a long common prefix lie in cells of their own, in text order, hot ones too."""
    names = [f"https://common-crawl.example/{i:03d}" for i in range(40)]
    rows = spark.createDataFrame([(n,) for i, n in enumerate(names) for _ in range(400 if i == 7 else 10)], "source string")
    cuts = hilbert.text_cuts(rows, "source", 16)
    total, first, want = 790, 0, {}
    for i, n in enumerate(names):
        want.setdefault(first * 16 // total, n)
        first += 400 if i == 7 else 10
    assert cuts == sorted(want.items())
    got = dict(rows.distinct().select("source", hilbert._text_cell("source", cuts).alias("cell")).collect())
    assert [got[n] for n in names] == [max(c for c, t in cuts if t <= n) for n in names]
    assert hilbert.text_cuts(rows.limit(0), "source", 16) == []


def test_a_very_long_text_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [(1, "x" * 2_000_000), (2, "y"), (3, None)]).withColumns({c: F.lit("c") for c in ("size", "curve", "at", "n", "first", "cell")})
    got = {r.doc_id: r.size for r in hilbert.places(docs).collect()}
    assert got == {1: 2_000_001, 2: 2, 3: 1}
