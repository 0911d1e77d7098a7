"""Benchmark leaks by canonical templates, also where a question got new numbers.

A text is read word by word, and as a template in which numbers, units and
names are typed placeholders (a run of names is one); the template twice, as a
capitalised word that begins a sentence may be a plain word or a name. Windows
of five words of every reading are hashed. A bit table over the benchmark's windows,
of fixed size whatever the benchmark, is asked in the scan of the documents;
only windows that pass leave it and are joined with the benchmark's by hash.
Template windows, with slots or without, count where their slots agree: along
one alignment of a document and an item, a value of the item stands for one
value in the document, and windows that say otherwise do not count. A document
leaks an item if at least ``SHARE`` of all the item's windows are found in one
of the readings.

Defined results: NULL, empty and punctuation-only texts have no windows and
leak nothing; an item of fewer than five words leaks only into a document with
the same words and no others; template windows with fewer than two plain words
are not compared; repeated rows are judged alike; empty tables give no leaks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import text_hash, without_rows
from vitrine.session import settle

WINDOW = 5
SHARE = 0.8
TABLE_BITS = 1 << 24
PLAIN_WORDS = 2
# Words that are units after a number.
UNITS = frozenset("""
    % ° $ € £ mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec min h hr hrs ms kb mb gb tb hz khz mhz ghz w kw v a k c f
    meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms
    pound pounds ounce ounces liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months
    year years percent degrees dollar dollars euro euros cent cents
    stunde stunden tag tage woche wochen monat monate jahr jahre minuten sekunden prozent heure heures jour jours semaine semaines mois an ans
    hora horas dia dias día días semana semanas mes meses año años
""".split())
NUMBER, UNIT, NAME, MEASURE = 1, 2, 3, 4
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*\Z")
_MEASURE = re.compile(r"[$€£]?[+-]?\d[\d.,]*(?:%|°?[a-zA-Zµ°]{1,4})\Z")
_EDGE = re.compile(r"^[^\w$€£+%°-]+|[^\w%°]+\Z")
_ENDS = re.compile(r"[.!?:;][\"'”’)\]]*\Z")
_KIND, _END = 33, 36  # bits above the word's own 33
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """A chunk between white space as one number: plain code, kind, and whether a sentence ends; -1 if it is no word."""

    def __missing__(self, chunk: str) -> int:
        if len(self) > 400_000:
            self.clear()
        word, ends = (chunk, False) if chunk.isalpha() else (chunk[:-1], chunk[-1] != ",")
        if word.isalpha() and (word is chunk or chunk[-1] in ".,!?:;"):  # most chunks: letters, and perhaps a mark
            low = word.lower()
            kind = UNIT if low in UNITS else NAME if word[0].isupper() and word[1:].islower() else 0
            code = self[chunk] = (zlib.crc32(low.encode()) + 16) | kind << _KIND | ends << _END
            return code
        word = _EDGE.sub("", chunk)
        if not re.search(r"\w|[%°$€£]", word):
            code = -1
        else:
            low = word.lower()
            kind = 0
            if _NUMBER.match(word):
                kind = NUMBER
            elif _MEASURE.match(word):
                kind = MEASURE
            elif low in UNITS:
                kind = UNIT
            elif word[0].isupper() and word[1:].islower():
                kind = NAME
            code = (zlib.crc32(low.encode()) + 16) | kind << _KIND | bool(_ENDS.search(chunk)) << _END
        self[chunk] = code
        return code


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _windows(codes: np.ndarray, reading: int) -> np.ndarray:
    """Hashes of the windows of one reading; a short text is one window."""
    n = len(codes) - WINDOW + 1
    width = WINDOW if n > 0 else len(codes)
    if not width:
        return np.empty(0, np.uint64)
    n = max(n, 1)
    codes = codes.astype(np.uint64)
    h = np.full(n, reading + 1 + 8 * width, np.uint64)
    for i in range(width):
        h = h * _PRIME + codes[i:i + n]
    return _mix(h)


def readings(text: str) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """For the plain and both template readings: window hashes, and the slot values (0: a plain word) of each token."""
    packed = np.fromiter(map(_words.__getitem__, text.split()), np.int64)
    packed = packed[packed >= 0]
    if not len(packed):
        return [(np.empty(0, np.uint64), None)]
    plain, kind = packed & ((1 << _KIND) - 1), packed >> _KIND & 7
    out = [(_windows(plain, 0), None)]
    if not kind.any():
        return out
    starts = np.append(True, (packed[:-1] >> _END & 1).astype(bool))
    after_number = np.append(False, kind[:-1] == NUMBER)
    named = np.where((kind == UNIT) & ~after_number, 0, kind)
    for reading, kind in ((1, np.where((named == NAME) & starts, 0, named)), (2, named)):
        if not kind.any():
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
            continue
        first = ~((kind == NAME) & np.append(False, kind[:-1] == NAME))
        at = np.flatnonzero(first)
        typed = np.where(kind[at] == 0, plain[at], kind[at])
        slots = np.where(kind[at] == 0, 0, np.add.reduceat(plain, at))
        # A first word that stands for any name says too little of a text of a few words.
        out.append((_windows(typed, reading), slots) if reading == 1 or len(at) >= WINDOW else (np.empty(0, np.uint64), slots[:0]))
    return out


def _slot_windows(slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    width = min(WINDOW, len(slots))
    return slots[at[:, None] + np.arange(width)]


def _inside(ends: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where the full windows of the asked texts begin, in the tokens of all texts, which end at ``ends``."""
    start = np.append(0, ends[:-1])
    count = np.where(asked, np.maximum(ends - start - WINDOW + 1, 0), 0)
    skipped = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(start - skipped, count)


def _hashes(codes: np.ndarray, at: np.ndarray, reading: int) -> np.ndarray:
    codes = codes.astype(np.uint64)
    h = np.full(max(0, len(codes) - WINDOW + 1), reading + 1 + 8 * WINDOW, np.uint64)
    for i in range(WINDOW):
        h = h * _PRIME + codes[i:i + len(h)]
    return _mix(h[at])


def batch_windows(texts: list[str | None], table: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(text's place, reading, hashes, places, slots) of the windows of many texts that pass the bit table.

    The tokens of all texts are one array; windows that would reach over a text's
    end are left out, and texts of fewer tokens than a window are read alone.
    """
    passes = lambda h: table[h & np.uint64(TABLE_BITS - 1)]
    packed = [np.fromiter(map(_words.__getitem__, t.split()), np.int64) if t else np.empty(0, np.int64) for t in texts]
    packed = [p[p >= 0] for p in packed]
    size = np.array([len(p) for p in packed])
    alone: list[tuple[int, int]] = [(i, r) for i in np.flatnonzero((size > 0) & (size < WINDOW)) for r in range(3)]
    codes, ends = np.concatenate([*packed, np.empty(0, np.int64)]), np.cumsum(size)
    plain, kind = codes & ((1 << _KIND) - 1), codes >> _KIND & 7
    long = size >= WINDOW
    at = _inside(ends, long)
    h = _hashes(plain, at, 0)
    hit = passes(h)
    of = lambda places, bounds: np.searchsorted(bounds, places, side="right")
    first = np.append(0, ends[:-1])
    text = of(at[hit], ends)
    yield text, 0, h[hit], at[hit] - first[text], None
    opens = np.zeros(len(codes), bool)
    opens[first[size > 0]] = True
    starts = opens | np.append(False, codes[:-1] >> _END & 1).astype(bool)[:len(codes)]
    before = np.where(opens, 0, np.append(0, kind[:-1])[:len(codes)])
    named = np.where((kind == UNIT) & (before != NUMBER), 0, kind)
    for reading, kind in ((1, np.where((named == NAME) & starts, 0, named)), (2, named)):
        before = np.where(opens, 0, np.append(0, kind[:-1])[:len(codes)])
        token = np.flatnonzero((kind != NAME) | (before != NAME))
        typed_ends = np.searchsorted(token, ends)
        typed_size = np.diff(np.append(0, typed_ends))
        some = np.zeros(len(texts), bool)
        some[of(np.flatnonzero(kind), ends)] = True
        if reading == 1:
            alone += [(i, 1) for i in np.flatnonzero(long & some & (typed_size < WINDOW))]
        at = _inside(typed_ends, long & some)
        h = _hashes(np.where(kind[token] == 0, plain[token], kind[token]), at, reading)
        hit = passes(h)
        if not hit.any():
            continue
        slots = np.where(kind[token] == 0, 0, np.add.reduceat(plain, token))
        text = of(at[hit], typed_ends)
        yield text, reading, h[hit], at[hit] - np.append(0, typed_ends[:-1])[text], _slot_windows(slots, at[hit])
    for i, reading in alone:
        found = readings(texts[i])
        if reading < len(found) and len(found[reading][0]):
            h, slots = found[reading]
            own = np.flatnonzero(passes(h))
            yield np.full(len(own), i), reading, h[own], own, None if slots is None else _slot_windows(slots, own)


_FOUND = "key bigint, th bigint, reading int, hash bigint, pos bigint, slots array<bigint>"


def _found(rows: DataFrame, known=None) -> DataFrame:
    """(key, th, reading, hash, pos, slots) of windows; with a bit table, only of those that pass it."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ones(TABLE_BITS, bool) if known is None else np.unpackbits(np.frombuffer(known.value, np.uint8), bitorder="little").view(bool)
        for batch in given:
            for text, reading, hashes, at, slots in batch_windows(batch.column("text").to_pylist(), table):
                values = [[]] * len(at)
                if slots is not None:
                    wordy = (slots == 0).sum(axis=1) >= PLAIN_WORDS
                    text, hashes, at, values = text[wordy], hashes[wordy], at[wordy], slots[wordy].tolist()
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(text)), batch.column("th").take(pa.array(text)), pa.array(np.full(len(at), reading, np.int32)),
                         pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int64)), pa.array(values, pa.list_(pa.int64()))],
                        names=["key", "th", "reading", "hash", "pos", "slots"])

    return rows.mapInArrow(batches, _FOUND)


def bit_table(windows: DataFrame) -> bytes:
    """The windows' hashes in TABLE_BITS bits: at most one row per 32 bits reaches the driver."""
    bit = F.col("hash").bitwiseAND(F.lit(TABLE_BITS - 1))
    words = windows.groupBy(F.floor(bit / 32).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 32).cast("int"))).alias("set"))
    table = np.zeros(TABLE_BITS // 32, "<u4")
    got = words.toArrow()
    table[got.column("word").to_numpy()] = got.column("set").to_numpy()
    return table.tobytes()


_JUDGED = "key bigint, th bigint, item_id bigint, item_th bigint, reading int, windows bigint, matched bigint"


def agreeing(found: list[dict]) -> int:
    """How many of an item's windows a document holds with slots that agree along an alignment.

    A value of the item stands for the value that most windows of the alignment
    give it, the first one in case of doubt; windows that give it another do not count.
    """
    shifts: dict[int, list[dict]] = {}
    for f in found:
        shifts.setdefault(f["shift"], []).append(f)
    kept: set[int] = set()
    for windows in shifts.values():
        votes: dict[int, dict[int, int]] = {}
        for w in sorted(windows, key=lambda w: w["item_pos"]):
            for ours, theirs in zip(w["ours"], w["theirs"]):
                if ours:
                    count = votes.setdefault(ours, {})
                    count[theirs] = count.get(theirs, 0) + 1
        stands = {ours: max(count, key=count.get) for ours, count in votes.items()}
        kept |= {w["item_pos"] for w in windows if all(not o or stands[o] == t for o, t in zip(w["ours"], w["theirs"]))}
    return len(kept)


def _agreeing_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        matched = [agreeing(f.as_py()) for f in batch.column("found")]
        names = ["key", "th", "item_id", "item_th", "reading", "windows"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(matched, pa.int64())], names=[*names, "matched"])


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, th, item_id, verbatim, windows, matched), one row per document and item it leaks."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("key"), text_hash().alias("th"), F.col("text").cast("string"))
    index = settle(_found(items.distinct()))
    sizes = index.groupBy("key", "th", "reading").agg(F.countDistinct("pos").alias("windows"))
    known = spark.sparkContext.broadcast(bit_table(index))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("key"), text_hash().alias("th"), F.col("text").cast("string"))
    # A window that one document repeats is asked for once per place: its alignment matters.
    hits = settle(_found(rows, known).distinct())
    wanted = index.select(
        F.col("key").alias("item_id"), F.col("th").alias("item_th"), "reading", "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    met = hits.join(wanted, ["reading", "hash"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    pair = ["key", "th", "item_id", "item_th"]
    sizes = sizes.select(F.col("key").alias("_item"), F.col("th").alias("_item_th"), F.col("reading").alias("_reading"), "windows")
    of_item = F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_th") == F.col("_item_th")) & (F.col("reading") == F.col("_reading"))
    reached = met.groupBy(*pair, "reading").agg(F.countDistinct("item_pos").alias("matched")).join(sizes, of_item)
    reached = settle(reached.filter(F.col("matched") >= F.col("windows") * share).select(*pair, "reading", "windows", "matched"))
    plain, typed = reached.filter("reading = 0"), reached.filter("reading > 0").drop("matched")
    typed = typed.select("windows", F.col("reading").alias("_reading"), *[F.col(c).alias(f"_{c}") for c in pair])
    same = F.col("reading") == F.col("_reading")
    for c in pair:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = F.collect_list(F.struct("shift", "item_pos", F.col("item_slots").alias("ours"), F.col("slots").alias("theirs"))).alias("found")
    aligned = met.filter("reading > 0").join(typed, same).groupBy(*pair, "reading", "windows").agg(found)
    agreeing = aligned.mapInArrow(_agreeing_batches, _JUDGED).filter(F.col("matched") >= F.col("windows") * share)
    enough = plain.unionByName(agreeing)
    best = F.min(F.struct("reading", "windows", "matched"))
    return enough.groupBy(F.col("key").alias("doc_id"), "th", "item_id").agg(best.alias("best")).select(
        "doc_id", "th", "item_id", (F.col("best.reading") == 0).alias("verbatim"), "best.windows", "best.matched")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that leak nothing, in the columns of ``docs``."""
    return without_rows(docs, leaks(docs, benchmark, share).select("doc_id", "th"))
