import numpy as np
import pytest
import xxhash

from tests.llm.frames import ODD, documents, words
from vitrine.llm import simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    parts = [w for w in low.split(" ") if w]
    grams = [" ".join(parts[i:i + 3]) for i in range(len(parts) - 2)] if len(parts) > 2 else [" ".join(parts)] if parts else []
    out = 0
    for bit in range(64):
        if sum(xxhash.xxh64_intdigest(g.encode(), 42) >> bit & 1 for g in grams) * 2 > len(grams):
            out |= 1 << bit
    return out


def plain_components(rows):
    marks = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(marks[i] ^ marks[j]).count("1") <= 3 and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    best = {}
    for (doc_id, _), g in zip(rows, label):
        if doc_id is not None:
            best[g] = min(best.get(g, doc_id), doc_id)
    return sorted(((d, marks[i], best.get(label[i])) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rows = [(i, words(i, 40)) for i in range(20)]
    rows += [(100 + i, words(3, 400) + " " + words(50 + i, 2)) for i in range(25)]  # near copies
    rows += [(200 + i, words(5, 60).upper()) for i in range(6)] + [(200, words(5, 60).upper())]
    return rows + [(r[0], r[1]) for r in ODD] + [(903, "?! ...")]


@pytest.mark.parametrize("limit", [2000, 3])
def test_components_equal_brute_force(spark, limit):
    rows = corpus()
    got = simhash.components(documents(spark, rows), limit).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == plain_components(rows)


def test_long_text_is_hashed_in_pieces(monkeypatch):
    text = words(1, 500)
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_STEP", 7)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_links_lose_nothing_in_crowded_files(spark):
    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 63, 4, dtype=np.int64)
    marks = {int(b) ^ sum(1 << int(k) for k in random.choice(20, random.integers(0, 6), replace=False)) for b in base for _ in range(60)}
    edges = simhash.links(spark.createDataFrame([(m,) for m in marks], "fp bigint"), limit=5)
    got = {r.u: r.root for r in simhash.connected(edges).collect()}
    marks = sorted(marks)
    label = {m: m for m in marks}
    for _ in marks:
        for a in marks:
            for b in marks:
                if (a ^ b).bit_count() <= 3:
                    label[a] = min(label[a], label[b])
    assert {m: got.get(m, m) for m in marks} == label


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u bigint, v bigint")
    assert {(r.u, r.root) for r in simhash.connected(edges).collect()} == {(i, 0) for i in range(1, 201)}


def test_keep_one_keeps_a_row_of_each_component(spark):
    docs = documents(spark, corpus())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    components = {r.component_id for r in simhash.components(docs).collect()}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(components, key=str)


def test_empty_table(spark):
    assert simhash.components(documents(spark, [])).count() == 0
    assert simhash.keep_one(documents(spark, [])).count() == 0


def test_many_links_are_held_as_a_forest(monkeypatch):
    random = np.random.default_rng(4)
    rows = np.unique(random.integers(0, 1 << 9, 120, dtype=np.int64))
    starts = np.array([0, 40])
    whole = simhash._link_files(rows, starts)
    monkeypatch.setattr(simhash, "_HELD_LINKS", 5)
    for a, b in zip(whole, simhash._link_files(rows, starts)):
        assert (a == b).all()
