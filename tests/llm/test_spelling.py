"""Spelling variants against edit distances of all pairs; odd rows; crowded lists."""

import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest

from tests.llm.frames import ODD, documents, words
from vitrine.llm import queries as Q
from vitrine.llm import spelling


def one_apart(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, ratio=5):
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [o for d in (-1, 0, 1) for o in by_length.get(len(w) + d, ()) if one_apart(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), counts[w], len(near[w]), counts[form[w]] if w in form else None) for w in counts}


def plain_counts(rows, times=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mark % 199 == 0:
                run = run[:mark % len(run)] + run[mark % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= times}


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.op12_spelling_variants(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(plain_counts(rows))


@pytest.mark.parametrize("crowd", [2, 3, 10, 2000])
def test_crowded_lists_lose_nothing(spark, crowd):
    """Words over two letters, so that most are near many others and every list is crowded."""
    drawn = {format(i * 37 % 509, "b").translate(str.maketrans("01", "ab"))[:8] for i in range(400)}
    drawn |= {"é" + w for w in list(drawn)[:40]} | {w + "é" for w in list(drawn)[:40]} | {"a", "b", "ab"}
    counts = {w: 5 + zlib.crc32(w.encode()) % 200 for w in drawn}
    frame = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n bigint, form string")
    got = spelling.variants(frame, crowd=crowd).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == plain(counts)


def test_odd_rows(spark):
    rows = [(i, "Abcdefg ABCDEFG abcdefh naïveté NAÏVETé x×y÷zzz l’amourx 東京abcdefg") for i in range(40)]
    rows += [(r[0], r[1]) for r in ODD] + [(None, "abcdefg"), (None, "abcdefg"), (41, "abcdefg " * 5), (41, "abcdefg"), (42, "-".join(["wordword"] * 3)), (43, None)]
    got = spelling.variants(spelling.runs(documents(spark, rows)))
    assert {tuple(r) for r in got.collect()} == plain(plain_counts(rows))
    assert spelling.variants(spelling.runs(documents(spark, []))).collect() == []


def test_ties_and_chains(spark):
    counts = {"aaaaaa": 5, "aaaaab": 30, "aaaaac": 30, "aaaabb": 200, "aaabbb": 1200, "zzzzzz": 7, "": 99}
    rows = [*counts.items(), ("zzzzzz", 2), (None, 4)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n bigint")).collect()}
    assert got["aaaaaa"].form == "aaaaab" and got["aaaaaa"].root == "aaabbb"  # the tie goes to the smaller word
    assert got["aaaabb"].form == "aaabbb" and got["aaabbb"].form is None and got["aaabbb"].root == "aaabbb"
    assert got["zzzzzz"].n == 9 and got["zzzzzz"].n_near == 0 and "" not in got and len(got) == 6


def test_long_texts_are_read_whole(monkeypatch):
    text = (words(3, 500) + " Éclair").encode()
    whole = [w for part in spelling.text_runs(text) for w in part]
    monkeypatch.setattr(spelling, "_SLICE", 17)
    assert [w for part in spelling.text_runs(text) for w in part] == whole and len(whole) == 501


def test_rows_are_the_edit_matrix():
    @lru_cache(maxsize=None)
    def distance(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(distance(a[1:], b) + 1, distance(a, b[1:]) + 1, distance(a[1:], b[1:]) + (a[0] != b[0]))

    some = sorted({format(i, "b") for i in range(1, 130)})
    for word, found in zip(some, spelling.near(some)):
        assert [some[j] for j in found] == [o for o in some if distance(word, o) == 1]
