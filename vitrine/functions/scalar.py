"""Scalar expressions: names, numbers, keys, money, dates and labels.

Everything here is a plain composition of built-in functions, so it stays in
whole-stage code generation. The one exception is :func:`name_similarity`,
which needs a sequence matcher and is an Arrow function meant for candidate
pairs only.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values -------------------------------------------------------------
SERIES_PREFIX = r"^(sv|swsh|sm|xy|bw|hgss|dp|ex|me)\d*\s*:\s*"
CONDITIONS = {
    "NM": ("Near Mint", 1.0),
    "LP": ("Lightly Played", 0.85),
    "MP": ("Moderately Played", 0.7),
    "HP": ("Heavily Played", 0.5),
    "DM": ("Damaged", 0.35),
}
GRADERS = ["PSA", "BGS", "CGC", "SGC", "ACE", "TAG"]
PLAIN_FIRST = ["Normal", "Unlimited", "1st Edition", "Holofoil"]
RARITY_TIERS = [
    ("secret", ["secret", "hyper", "rainbow"]),
    ("illustration", ["illustration", "star", "shiny"]),
    ("ultra", ["ultra", "vmax", "vstar", "ex"]),
    ("double", ["double", "holo"]),
    ("rare", ["rare"]),
    ("uncommon", ["uncommon"]),
    ("promo", ["promo"]),
]
PRODUCT_URL_PREFIX = "https://www.tcgplayer.com/product/"
ASSET_HOST = "https://images.pokemontcg.io"
STALE_AFTER_DAYS = 10
FREE_PER_DAY, PER_AD, ADS_PER_DAY = 30, 10, 5
# ---------------------------------------------------------------------------


def strip_space(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def norm_name(c: Column) -> Column:
    """Lower-case, drop a leading series code, squeeze the rest to words."""
    bare = F.regexp_replace(F.lower(c), SERIES_PREFIX, "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def norm_number(c: Column) -> Column:
    """``004/102`` -> ``4``; ``TG01/TG30`` -> ``tg1``; NULL stays NULL."""
    head = strip_space(F.substring_index(c.cast("string"), "/", 1))
    return F.lower(F.regexp_replace(head, r"^([A-Za-z]*)0*(\d+)([A-Za-z]*)$", "$1$2$3"))


def id_abbrevs(c: Column) -> Column:
    """Abbreviations a set id may go by: bare and two-digit forms."""
    pattern = r"^([a-z]+)0*(\d+)"
    prefix = F.upper(F.regexp_extract(c, pattern, 1))
    number = F.regexp_extract(c, pattern, 2)
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    forms = F.array_distinct(F.array(F.concat(prefix, number), F.concat(prefix, padded)))
    return F.when(c.rlike(pattern), forms).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; one matcher is kept per distinct right side."""
    out = []
    matcher = SequenceMatcher(None)
    last = None
    for left, right in zip(a, b):
        if left is None or right is None:
            out.append(None)
            continue
        if right != last:
            matcher.set_seq2(right)
            last = right
        matcher.set_seq1(left)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def base_name(c: Column) -> Column:
    """The name without a trailing parenthetical, unless it starts with one."""
    return F.when(F.instr(c, " (") > 1, F.substring_index(c, " (", 1)).otherwise(c)


def score_text(score: Column) -> Column:
    """A grade score as text: integers bare, halves with one decimal."""
    whole = score == F.floor(score)
    return F.when(whole, score.cast("bigint").cast("string")).otherwise(
        F.format_string("%.1f", score.cast("double"))
    )


def pile_key(
    card: Column, variant: Column, condition: Column,
    grader: Column | None = None, score: Column | None = None,
) -> Column:
    """Identity of a pile: card, printing, condition and, if any, grade."""
    parts = [card.cast("string"), variant, condition]
    if grader is not None:
        # A NULL grade drops out of concat_ws, leaving the three-part key.
        parts.append(F.concat(grader, score_text(score)))
    return F.concat_ws("|", *parts)


def _ladder(c: Column, at: int, fallback) -> Column:
    out = None
    for key, entry in CONDITIONS.items():
        out = F.when(c == key, F.lit(entry[at])) if out is None else out.when(c == key, F.lit(entry[at]))
    return out.otherwise(F.lit(fallback))


def condition_multiplier(c: Column) -> Column:
    return _ladder(c, 1, 1.0)


def condition_label(c: Column) -> Column:
    return _ladder(c, 0, "Near Mint")


def quote_price(price: Column, condition: Column) -> Column:
    """What one copy is quoted at in the given condition."""
    return price * condition_multiplier(condition)


def line_value(price: Column, condition: Column, graded: Column, quantity: Column) -> Column:
    """Value of a pile: no price is worth 0, a graded copy is not discounted."""
    multiplier = F.when(graded, F.lit(1.0)).otherwise(condition_multiplier(condition))
    return F.coalesce(price * multiplier * quantity, F.lit(0.0))


def money_exact(c: Column) -> Column:
    """Four-decimal money; sums of it do not depend on the order of rows."""
    return c.cast("decimal(20,4)")


def grade_label(grader: Column, score: Column) -> Column:
    return F.concat_ws(" ", grader, score_text(score))


def fixed2(c: Column) -> Column:
    """Two decimals, halves away from zero, as text."""
    return F.round(c.cast("decimal(24,6)"), 2).cast("decimal(24,2)").cast("string")


def day_of(ts: Column) -> Column:
    """Calendar day in the session time zone, as ``YYYY-MM-DD``."""
    return F.date_format(ts, "yyyy-MM-dd")


def days_old(updated: Column, now: Column) -> Column:
    """Whole days between a file's date text and now; NULL if unreadable."""
    return F.datediff(F.to_date(now), F.try_to_date(updated, "yyyy-M-d")).cast("bigint")


def freshness_label(updated: Column, now: Column) -> Column:
    days = days_old(updated, now)
    months = F.floor(days / 30 + 0.5).cast("bigint")
    return (
        F.when(days.isNull(), F.concat(F.lit("updated "), updated))
        .when(days <= 0, F.lit("updated today"))
        .when(days == 1, F.lit("updated yesterday"))
        .when(days < 30, F.concat(F.lit("updated "), days.cast("string"), F.lit(" days ago")))
        .otherwise(
            F.concat(
                F.lit("updated "), months.cast("string"),
                F.when(months == 1, F.lit(" month ago")).otherwise(F.lit(" months ago")),
            )
        )
    )


def is_stale(updated: Column, now: Column, after: int = STALE_AFTER_DAYS) -> Column:
    return F.coalesce(days_old(updated, now) > after, F.lit(True))


def short_day(d: Column) -> Column:
    """``3 Aug``; text that is no date comes back unchanged."""
    parsed = F.try_to_date(d, "yyyy-M-d")
    return F.coalesce(F.date_format(parsed, "d MMM"), d)


def money_label(v: Column) -> Column:
    return (
        F.when(v.isNull(), F.lit("—"))
        .when((v > 0) & (v < 0.005), F.lit("<$0.01"))
        .otherwise(F.concat(F.lit("$"), F.format_number(F.round(v, 2), 2)))
    )


def money_short(v: Column) -> Column:
    thousands = F.floor(v / 1000 + 0.5).cast("bigint").cast("string")
    tenths = F.format_string("%.1f", F.floor(v / 100 + 0.5) / 10)
    return (
        F.when(v >= 100000, F.concat(F.lit("$"), thousands, F.lit("k")))
        .when(v >= 10000, F.concat(F.lit("$"), tenths, F.lit("k")))
        .otherwise(money_label(v))
    )


def rarity_tier(r: Column) -> Column:
    """First matching class, in order; NULL and empty text are their own tier."""
    text = F.lower(r)
    out = F.when(r.isNull() | (r == ""), F.lit("none"))
    for tier, words in RARITY_TIERS:
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        out = out.when(hit, F.lit(tier))
    return out.otherwise(F.lit("other"))


def clean_label(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 40)


def product_url(pid: Column) -> Column:
    return F.when(pid.isNotNull(), F.concat(F.lit(PRODUCT_URL_PREFIX), pid.cast("string")))


def safe_file_name(c: Column, suffix: str = ".png") -> Column:
    return F.concat(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{IsDigit}_-]", "_"), F.lit(suffix))


def asset_urls(set_id: Column, number: Column) -> Column:
    """Struct of the four URLs derived from a card's set and number."""
    root = F.concat(F.lit(ASSET_HOST + "/"), set_id)
    return F.struct(
        F.concat(root, F.lit("/"), number, F.lit(".png")).alias("image"),
        F.concat(root, F.lit("/"), number, F.lit("_hires.png")).alias("image_hires"),
        F.concat(root, F.lit("/symbol.png")).alias("symbol"),
        F.concat(root, F.lit("/logo.png")).alias("logo"),
    )


def match_confidence(
    distance: Column, margin: Column, resolved: Column, bits: int = 742, band: int = 40,
) -> Column:
    part = F.when(resolved, F.lit(1.0)).otherwise(F.least(F.lit(1.0), margin / F.lit(float(band))))
    raw = (1 - distance / F.lit(float(bits)) * 2.2) * (0.55 + 0.45 * part)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def to_luma(b: Column, g: Column, r: Column) -> Column:
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b)


def set_of_card_id(c: Column) -> Column:
    return F.regexp_replace(c, "-[^-]*$", "")


def _json_kind(raw: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(raw, path, "variant"))


def repair_allowance(doc: Column, now: Column) -> Column:
    """Repair an allowance document (JSON text) field by field.

    Anything that is not a finite, non-negative number falls back to the fresh
    value; counters are floored and capped, and ``pro`` holds only for a JSON
    ``true``.
    """
    raw = F.try_parse_json(doc)
    today = day_of(now)

    def number(name: str, fallback: int) -> Column:
        path = "$." + name
        value = F.try_variant_get(raw, path, "double")
        usable = _json_kind(raw, path).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
        return F.coalesce(
            F.when(usable & (value >= 0) & (value < float("inf")), F.floor(value)).cast("bigint"),
            F.lit(fallback).cast("bigint"),
        )

    def text(name: str) -> Column:
        path = "$." + name
        return F.coalesce(
            F.when(_json_kind(raw, path) == "STRING", F.try_variant_get(raw, path, "string")), today,
        )

    pro = (_json_kind(raw, "$.pro") == "BOOLEAN") & F.try_variant_get(raw, "$.pro", "boolean")
    return F.struct(
        F.coalesce(pro, F.lit(False)).alias("pro"),
        F.least(number("freeLeft", FREE_PER_DAY), F.lit(FREE_PER_DAY).cast("bigint")).alias("free_left"),
        text("freeDay").alias("free_day"),
        number("credits", 0).alias("credits"),
        F.least(number("adsToday", 0), F.lit(ADS_PER_DAY).cast("bigint")).alias("ads_today"),
        text("adsDay").alias("ads_day"),
        number("scansEver", 0).alias("scans_ever"),
        number("creditsEver", 0).alias("credits_ever"),
    )


SNAPSHOT_ENTRY = (
    "key STRING, cardId STRING, name STRING, setName STRING, setId STRING, number STRING, "
    "rarity STRING, variant STRING, condition STRING, quantity BIGINT, unitPrice DOUBLE, "
    "addedAt BIGINT, updatedAt BIGINT, needsPrinting BOOLEAN, "
    "grade STRUCT<grader: STRING, score: DOUBLE>"
)
SNAPSHOT_WANT = (
    "cardId STRING, name STRING, setName STRING, number STRING, unitPrice DOUBLE, addedAt BIGINT"
)
SNAPSHOT_POINT = "day STRING, value DOUBLE, cards BIGINT"


def _struct_type(fields: str) -> str:
    parts, depth, cur = [], 0, ""
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    parts.append(cur.strip())
    return "struct<" + ",".join(p.split(" ", 1)[0] + ":" + p.split(" ", 1)[1] for p in parts) + ">"


def child_array(raw: Column, path: str, fields: str) -> Column:
    """A JSON array child as typed structs; anything else becomes ``[]``."""
    kind = f"array<{_struct_type(fields)}>"
    is_array = _json_kind(raw, path).startswith("ARRAY")
    return F.coalesce(
        F.when(is_array, F.try_variant_get(raw, path, kind)), F.array().cast(kind),
    )


def repair_snapshot(doc: Column) -> Column:
    """A replica snapshot from JSON text, with unusable children emptied."""
    raw = F.try_parse_json(doc)
    is_object = _json_kind(raw, "$.removed").startswith("OBJECT")
    removed = F.coalesce(
        F.when(is_object, F.try_variant_get(raw, "$.removed", "map<string,bigint>")),
        F.create_map().cast("map<string,bigint>"),
    )
    return F.struct(
        child_array(raw, "$.entries", SNAPSHOT_ENTRY).alias("entries"),
        child_array(raw, "$.wishlist", SNAPSHOT_WANT).alias("wishlist"),
        child_array(raw, "$.history", SNAPSHOT_POINT).alias("history"),
        removed.alias("removed"),
    )
