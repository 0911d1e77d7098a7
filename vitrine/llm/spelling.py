"""Spelling variants: words one edit apart, each led to the far commoner one it is a form of.

``runs`` counts the words of whole texts. ``variants`` finds, for every word, the
words at an edit distance of one by scanning sorted lists: an edit matrix is
kept as banded rows, one for each letter of the word that is scanned; the rows
for the letters that a word shares with the one before it (their longest common
prefix) are used again, and where a row holds nothing under two all words that
share these letters are skipped.

A list is never the whole vocabulary. Two words one edit apart agree before and
after the edit, so one half of the letters is the same: words of ``m`` and ``m-1``
letters are filed by the first (m-1)/2 letters, and read backwards by the last
ones. A crowded list is filed anew under one letter more; the pairs that differ
just there agree in all that follows, and are filed under that. So a list has
``CROWD`` words at most, or as many as there are letters, at any size of the
vocabulary. A list gives one row per word, a count and the best near word, and
never its pairs.

Defined results: a NULL text has no words, a NULL id counts as an empty text; a
NULL or empty word is dropped; counts of a repeated word are added; among equally
frequent near words the smallest in code-point order is the form; an empty table
has no words. Further columns are ignored. A very long text is read in slices
that end between words.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import settle

LETTERS, TIMES, RATIO = 6, 5, 5
MODULUS = 199
CROWD = 2000
_SLICE = 1 << 20
_HELD = 200_000
_OWN = bytes(range(0x61, 0x7B)) + b"\xc3" + bytes(range(0x80, 0xC0))  # a-z and the two bytes of U+00C0 to U+00FF
_TO_SPACE = bytes.maketrans(bytes(sorted(set(range(256)) - set(_OWN))), b" " * (256 - len(_OWN)))
_OTHER = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]*")  # characters of more than one byte that are no letters here
_TOP = chr(0x10FFFF)


def text_runs(text: bytes) -> Iterator[list[bytes]]:
    """The runs of letters of a UTF-8 text, A-Z lower-cased, slice by slice."""
    spaced = _OTHER.sub(b" ", text.lower()).translate(_TO_SPACE)
    at = 0
    while at < len(spaced):
        end = spaced.find(b" ", at + _SLICE)
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def _letters(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def runs(docs: DataFrame, least: int = LETTERS, modulus: int = MODULUS) -> DataFrame:
    """(word, n), partial counts: the words of at least ``least`` letters of all texts.

    Where ``modulus`` divides the crc32 of id and word, one letter of the word is left out.
    """

    def flush(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = [w for w in counts if _letters(w) >= least]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in given:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                text = text.as_py()
                if not text:
                    continue
                own: Counter = Counter()
                for words in text_runs(text):
                    own.update(words)
                seed = zlib.crc32(b"%s:" % (doc_id or "").encode())
                for word, n in own.items():
                    if len(word) < least:
                        continue
                    mark = zlib.crc32(word, seed)
                    if mark % modulus == 0:
                        full = word.decode()
                        at = mark % len(full)
                        word = (full[:at] + full[at + 1:]).encode()
                    total[word] += n
                if len(total) > _HELD:
                    yield flush(total)
                    total.clear()
        yield flush(total)

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "word string, n bigint")


def _rows() -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """Successors of a banded row by which of three letters match, and the row's cells.

    A row holds the distances to the query's first i-1, i and i+1 letters, 2 for
    anything above one; there are 27 rows, and 8 ways to match.
    """
    cells = list(product(range(3), repeat=3))
    number = {c: i for i, c in enumerate(cells)}
    after = []
    for a, b, c in cells:
        one = []
        for match in range(8):
            x = min(a + (not match & 1), b + 1)
            y = min(b + (not match & 2), c + 1, x + 1)
            z = min(c + (not match & 4), y + 1)
            one.append(number[min(x, 2), min(y, 2), min(z, 2)])
        after.append(one)
    return after, cells


_AFTER, _CELLS = _rows()
_START, _DEAD = _CELLS.index((1, 0, 1)), _CELLS.index((2, 2, 2))


def _shared(a: str, b: str, start: int) -> int:
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


def near(words: list[str], same: int = 0) -> Iterator[list[int]]:
    """For each of the sorted words the places of those at distance one; all share their first ``same`` letters."""
    prefix = [same] + [_shared(a, b, same) for a, b in zip(words, words[1:])]
    n, most = len(words), max(map(len, words), default=0)
    rows = [_START] * (most + 1)
    for query in words:
        long, asked, found = len(query), "\0" + query + "\0\0\0", []
        at, valid = 0, same
        while at < n:
            word = words[at]
            i, end = min(valid, prefix[at]), len(word)
            row = rows[i]
            while i < end:
                letter = word[i]
                row = _AFTER[row][(letter == asked[i]) + 2 * (letter == asked[i + 1]) + 4 * (letter == asked[i + 2])]
                i += 1
                if row == _DEAD:
                    at = bisect_left(words, word[:i] + _TOP, at + 1)
                    break
                rows[i] = row
            else:
                if -2 < long - end < 2 and _CELLS[row][long - end + 1] == 1:
                    found.append(at)
                at += 1
            valid = i
        yield found


def _scan(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list and word to one row per word that has near words in its list."""

    def scanned(group: tuple, words: list[str], counts: list[int]) -> pa.RecordBatch:
        back, m, same, gap, _ = group
        half = m // 2
        out: tuple[list, ...] = ([], [], [], [])
        for i, found in enumerate(near(words, same)) if len(words) > 1 else ():
            word, total, best = words[i], 0, None
            for j in found:
                other = words[j]
                if max(len(word), len(other)) != m or gap and word[same:same + 1] == other[same:same + 1]:
                    continue  # found in another list
                shown = other
                if back:
                    shown = other[::-1]
                    if word[::-1][:half] == shown[:half]:
                        continue  # found reading forwards
                total += 1
                here = (-counts[j], shown)
                best = here if best is None or here < best else best
            if total:
                for column, value in zip(out, (word[::-1] if back else word, total, -best[0], best[1])):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

    group, words, counts = None, [], []
    for batch in given:
        columns = [batch.column(c).to_pylist() for c in ("back", "m", "same", "gap", "key", "word", "n")]
        for *own, word, n in zip(*columns):
            if own != group:
                if words:
                    yield scanned(group, words, counts)
                group, words, counts = own, [], []
            words.append(word)
            counts.append(n)
    if words:
        yield scanned(group, words, counts)


def _lists(words: DataFrame, crowd: int) -> DataFrame:
    """(back, m, same, gap, key, word, n): every word in each of its lists, none of which is crowded."""
    length = F.length("word")
    both = F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("word")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("word")))
    rows = words.select(F.explode(both).alias("w"), "n", length.alias("length"))
    rows = rows.select("w.back", "w.word", "n", F.explode(F.array("length", F.col("length") + 1)).alias("m"))
    rows = rows.withColumn("same", (F.col("m") / 2).cast("int")).withColumn("gap", F.lit(False))
    rows = rows.withColumn("key", F.expr("substring(word, 1, same)"))
    own = ["back", "m", "same", "gap", "key"]
    done = None
    while True:
        rows = settle(rows)
        sizes = rows.groupBy(*own).count()
        full = settle(sizes.filter(F.col("count") > crowd).select(*own))
        found = sizes.filter(F.col("count").between(2, crowd)).select(*own)
        kept = rows.join(found, own)
        done = kept if done is None else done.unionByName(kept)
        if full.isEmpty():
            return done
        open_rows = rows.join(full, own, "left_semi")
        deeper = open_rows.filter(F.length("word") > F.col("same")).withColumn("same", F.col("same") + 1)
        deeper = deeper.withColumn("key", F.expr("substring(word, 1, same)"))
        rest = F.expr("substring(word, length(word) - (m - same - 1) + 1)")
        gaps = open_rows.withColumn("gap", F.lit(True)).withColumn("key", F.concat("key", F.lit("|"), rest))
        done = done.unionByName(gaps)
        rows = deeper


def variants(words: DataFrame, times: int = TIMES, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words that occur ``times`` times at least.

    ``form`` is the most frequent near word if it is ``ratio`` times as frequent;
    ``root`` is where the forms of forms end.
    """
    spark = words.sparkSession
    vocabulary = words.filter("word <> ''").groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    vocabulary = settle(vocabulary.filter(F.col("n") >= times))
    lists = _lists(vocabulary, crowd)
    own = ["back", "m", "same", "gap", "key"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.select(*own, "word", "n").repartition(parts, *own).sortWithinPartitions(*own, "word")
    found = dealt.mapInArrow(_scan, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("no"), F.col("best").alias("best"))).alias("b")
    near_words = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    rows = vocabulary.join(near_words, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(-F.col("b.no") >= ratio * F.col("n"), F.struct(F.col("b.best").alias("form"), (-F.col("b.no")).alias("n"))).alias("f"))
    rows = settle(rows.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")))
    return rows.join(_roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(rows: DataFrame) -> DataFrame:
    """(word, root) of the words with a form; every round doubles the steps that are taken at once.

    A form is more frequent than its word, so there are no circles.
    """
    up = settle(rows.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.filter("moved").isEmpty():
            return up
        up = moved.select("word", "root")
