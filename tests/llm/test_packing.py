import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from tests.llm.frames import ODD, documents, words
from vitrine.llm import packing, septokens, tokens


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZé ½'std.\n\x1c\x85\xa0İΣ́<|endoftext|>")), max_size=60))
def test_word_ids_equal_the_tokenizer(text):
    whole = tokens.word_ids()._tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.word_ids().encode(text), "<u4").tolist() == whole


def test_long_texts_go_in_slices(monkeypatch, reference):
    monkeypatch.setattr(tokens, "_SLICE", 50)
    text = words(1, 300) + " " + "x" * 200 + "\n" + words(2, 30)
    assert np.frombuffer(tokens.word_ids().encode(text), "<u4").tolist() == reference(text)


def best_count(lengths, capacity):
    """Fewest sequences, by trying everything."""
    best = [len(lengths)]

    def go(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[at] <= capacity and bins[i] not in bins[:i]:
                go(at + 1, bins[:i] + [bins[i] + lengths[at]] + bins[i + 1:])
        go(at + 1, bins + [lengths[at]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=10))
def test_fixed_sets_keep_a_best_packing_in_reach(lengths):
    lengths.sort(reverse=True)
    counts = {n: lengths.count(n) for n in lengths}
    instance = packing.Instance(dict(counts), 20)
    packing.reduce_instance(instance)
    fixed = sum(times for _, times in instance.sets)
    left = [n for n, c in sorted(instance.counts.items(), reverse=True) for _ in range(c)]
    assert fixed + best_count(left, 20) == best_count(lengths, 20)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 10**9), max_size=40))
def test_plan_uses_every_piece_once_and_overfills_nothing(counts):
    sets = packing.plan(counts, 64)
    used = {}
    for chosen, times in sets:
        assert sum(chosen) <= 64 and times > 0
        for n in chosen:
            used[n] = used.get(n, 0) + times
    assert used == counts


def test_documents_are_packed_whole(spark, reference):
    rows = [(i, words(i, 20 + 37 * i % 700)) for i in range(40)] + [(77, words(3, 3000)), (78, words(4, 5))] + [(80 + i, "same words here") for i in range(30)] + [r[:2] for r in ODD]
    got = packing.pack_documents(documents(spark, rows), capacity=512).collect()
    want = []
    for doc_id, text in rows:
        ids = np.array(reference(text) + [0], "<u4")
        for at in range(0, len(ids), 512):
            part = ids[at:at + 512]
            want.append((doc_id, at // 512, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 512
    assert len(sequences) <= -(-sum(r.length for r in got) // 512) * 1.1 + 1
    assert packing.pack_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("block", [64, 4 << 20])
def test_separator_scan_counts_tokens(spark, reference, block):
    rows = [(i, words(i, 30 + i)) for i in range(40)] + [r[:2] for r in ODD] + [(5, "again"), (5, "again")]
    got = septokens.count_documents(documents(spark, rows), block_bytes=block).collect()
    assert sorted(((r.doc_id, r.tokens) for r in got), key=str) == sorted(((d, len(reference(t))) for d, t in rows), key=str)
    assert septokens.count_documents(documents(spark, [])).count() == 0


def test_scan_of_a_file_with_an_open_end(spark, tmp_path):
    end = septokens.END_ID
    ids = [end, 1, 2, end, 3, 4, 5, 6, 7, end, end, 8]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(np.array([9, 9, 9], "<u2").tobytes())
    (tmp_path / "c.bin").write_bytes(b"")
    for block in (2, 4, 10, 1000):
        got = septokens.scan(septokens.list_blocks(spark, str(tmp_path), block)).collect()
        assert sorted((r.file, r.ordinal, r.start, r.tokens, r.closed) for r in got) == [
            ("a.bin", 0, 0, 0, True), ("a.bin", 1, 1, 2, True), ("a.bin", 2, 4, 5, True), ("a.bin", 3, 10, 0, True), ("a.bin", 4, 11, 1, False),
            ("b.bin", 0, 0, 3, False)]
