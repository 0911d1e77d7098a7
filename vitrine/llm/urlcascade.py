"""URL rules by a cascade of Bloom filters: exact membership by bit tests alone.

The keys of a page are the host's suffixes at label borders, each with the
prefixes of its path that are as long as some rule's path. All keys of the
corpus are the cascade's universe. Level 0 holds the listed keys; level 1 the
universe's other keys that level 0 lets through; level 2 the listed keys that
level 1 lets through, and so on until nothing false is left. For every key of
the universe the first level that turns it away tells whether it is listed.
Pages are then judged in place, without a join.

Only bit tables reach the driver. A table has ``BITS_PER_KEY`` bits per key and
at most ``MAX_BITS``; beyond that more keys pass, so the cascade gets deeper,
not wrong, and lists of about 90 million keys fit.

Defined results: a NULL url, or one without ``://``, has an empty host and an
empty path, fits no rule and gets the default verdict. Repeated pages are
judged alike; an empty rule list or page table is fine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.session import settle

BITS_PER_KEY = 12
HASHES = 4
MAX_BITS = 1 << 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    bits: int
    words: str  # 64-bit words in decimal, separated by commas
    number: int


def _positions(key: Column, bits: int, number: int) -> list[Column]:
    one, two = (F.pmod(F.xxhash64(F.lit(2 * number + i), key), F.lit(bits)) for i in (0, 1))
    return [(one + i * two) % bits for i in range(HASHES)]


def _fill(keys: DataFrame, number: int, n: int, max_bits: int) -> Level:
    """One level over n distinct keys: bits are or-ed in the map tasks, words come to the driver."""
    bits = min(max_bits, -(-max(1, n) * BITS_PER_KEY // 64) * 64)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, number))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("set"))
    table = [0] * (bits // 64)
    for row in words.toLocalIterator():
        table[row.word] = row.set
    return Level(bits, ",".join(map(str, table)), number)


def passes(level: Level, key: Column) -> Column:
    """Whether a level lets a key through."""
    words = F.split(F.lit(level.words), ",").cast("array<bigint>")  # folded to one literal
    out = F.lit(True)
    for at in _positions(key, level.bits, level.number):
        word = F.get(words, F.floor(at / 64).cast("int"))
        out = out & (F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def build_cascade(universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS) -> list[Level]:
    """Levels over (key) frames; ``universe`` may repeat keys, and hold listed ones or not."""
    listed = settle(listed.select("key").filter("key is not null").distinct())
    levels = [_fill(listed, 0, listed.count(), max_bits)]
    # Level 0 is asked in the scan of the corpus; what passes is reduced before it is shuffled.
    through = universe.select("key").filter(passes(levels[0], F.col("key"))).distinct()
    inside, against = listed, settle(through.join(listed, "key", "left_anti"))
    while (n := against.count()) and len(levels) < 200:
        level = _fill(against, len(levels), n, max_bits)
        levels.append(level)
        inside, against = against, settle(inside.filter(passes(level, F.col("key"))))
    if n:
        raise ValueError(f"{n} keys are left after {len(levels)} levels: raise max_bits")
    return levels


def listed_in(levels: list[Level], key: Column) -> Column:
    """Exact for every key of the universe the cascade was built over."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(passes(level, key), out).otherwise(F.lit(level.number % 2 == 1))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substr(url, F.length(rest) + 4)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every (host suffix, path prefix) of a page that a rule could name, as an array of keys."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fits, lambda n: F.concat(s, F.substr(path, F.lit(1), n)))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """Add host, path, rule and verdict to (page_id, url); ``rules`` is (verdict, host, path).

    The longest fitting rule wins. A key under both verdicts is blocked.
    """
    lengths = [r.n for r in rules.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    keyed = named.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    lists = {}
    for verdict in ("block", "allow"):
        own = rules.filter(F.col("verdict") == verdict).select(F.concat("host", "path").alias("key"))
        lists[verdict] = build_cascade(universe, own, max_bits)

    def hits(verdict):
        fit = F.filter("keys", lambda k: listed_in(lists[verdict], k))
        return F.transform(fit, lambda k: F.struct(F.length(k).alias("n"), F.lit(verdict).alias("verdict"), k.alias("rule")))

    best = F.array_max(F.concat(hits("block"), hits("allow")))
    judged = keyed.withColumn("best", best)
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
