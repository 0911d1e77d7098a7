import datetime

from pyspark.sql import functions as F

from vitrine.functions import bits as B
from vitrine.functions import scalar as S

NOW = lambda: F.lit("2026-08-14 10:00:00").cast("timestamp")


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_norm_number(spark):
    values = ["004/102", "TG01/TG30", "SV049", None, " 12 ", "A-1", "000"]
    assert column(spark, values, S.norm_number) == ["4", "tg1", "sv49", None, "12", "a-1", "0"]


def test_norm_name(spark):
    assert column(spark, ["SV01: Scarlet & Violet", "SM - Burning  Shadows", "Exotic"], S.norm_name) == [
        "scarlet violet", "sm burning shadows", "exotic"]


def test_id_abbrevs(spark):
    got = column(spark, ["sm1", "swsh12", "sv3pt5", "12x", "ab007", "x120"], S.id_abbrevs)
    assert got == [["SM1", "SM01"], ["SWSH12"], ["SV3", "SV03"], [], ["AB7", "AB07"], ["X120"]]


def test_base_name(spark):
    assert column(spark, ["Research (Sada)", " (x)", "Plain"], S.base_name) == ["Research", " (x)", "Plain"]


def test_freshness(spark):
    days = ["2026-08-14", "2026-08-13", "2026-08-11", "2026-06-30", "2026-05-16", "soon"]
    assert column(spark, days, lambda c: S.freshness_label(c, NOW())) == [
        "updated today", "updated yesterday", "updated 3 days ago", "updated 2 months ago", "updated 3 months ago", "updated soon"]
    assert column(spark, ["2026-08-04", "2026-08-03", "x"], lambda c: S.is_stale(c, NOW())) == [False, True, True]


def test_money(spark):
    values = [None, 0.0, 0.004, 1234.5, 12345.6, 99999.0, 100000.0, 1.005]
    assert column(spark, values, S.money_label, "double") == [
        "—", "$0.00", "<$0.01", "$1,234.50", "$12,345.60", "$99,999.00", "$100,000.00", "$1.01"]
    assert column(spark, values, S.money_short, "double")[4:7] == ["$12.3k", "$100.0k", "$100k"]


def test_rarity(spark):
    values = ["Rare Secret", "Rare Holo VMAX", "Special Illustration Rare", "Rare Holo", "Uncommon", "Promo", "Common", None, ""]
    assert column(spark, values, S.rarity_tier) == [
        "secret", "ultra", "illustration", "double", "uncommon", "promo", "other", "none", "none"]


def test_grade_and_key(spark):
    df = spark.createDataFrame([("c", "Normal", "NM", "BGS", 9.5), ("c", "Normal", "NM", "PSA", 10.0), ("c", "Normal", "NM", None, None)],
                               "card string, v string, cond string, g string, s double")
    rows = df.select(S.pile_key(*[F.col(x) for x in df.columns]).alias("k"), S.grade_label(F.col("g"), F.col("s")).alias("l")).collect()
    assert [r["k"] for r in rows] == ["c|Normal|NM|BGS9.5", "c|Normal|NM|PSA10", "c|Normal|NM"]
    assert [r["l"] for r in rows][:2] == ["BGS 9.5", "PSA 10"]


def test_allowance_repair(spark):
    docs = ['{"pro":1,"freeLeft":99,"credits":-1,"adsToday":2.9}', "nonsense", '{"pro":true,"freeLeft":"7","scansEver":1e3}']
    got = column(spark, docs, lambda c: S.repair_allowance(c, NOW()))
    assert (got[0].pro, got[0].free_left, got[0].credits, got[0].ads_today) == (False, 30, 0, 2)
    assert (got[1].free_left, got[1].free_day) == (30, "2026-08-14")
    assert (got[2].pro, got[2].free_left, got[2].scans_ever) == (True, 30, 1000)


def test_snapshot_repair(spark):
    docs = ['{"entries":{},"wishlist":[{"cardId":"a","addedAt":5}],"removed":{"k":3}}', "[]", None]
    got = column(spark, docs, S.repair_snapshot)
    assert got[0].entries == [] and got[0].wishlist[0].cardId == "a" and got[0].removed == {"k": 3}
    assert got[1].removed == {} and got[2].history == []


def test_day_labels(spark):
    assert column(spark, ["2026-08-03", "later"], S.short_day) == ["3 Aug", "later"]
    assert column(spark, [datetime.datetime(2026, 8, 14, 23, 59)], S.day_of, "timestamp") == ["2026-08-14"]


def test_pack_and_unpack(spark):
    bits = [[int(x) for x in format(i * 2654435761 % 2**32, "032b") * 3][:70] for i in range(20)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "i int, b array<int>")
    words = df.select("i", B.pack_bits(F.col("b"), 70).alias("w"))
    back = words.select("i", B.unpack_bits(F.col("w"), 70).alias("b"), B.bit_at(F.col("w"), 69).alias("last")).orderBy("i").collect()
    assert [r["b"] for r in back] == bits and [r["last"] for r in back] == [b[69] for b in bits]
    binary = words.select("i", B.words_to_binary(F.col("w"), 2, 16).alias("d"))
    again = binary.select("i", B.words_from_binary(F.col("d"), 16).alias("w")).orderBy("i").collect()
    assert [r["w"] for r in again] == [r["w"] for r in words.orderBy("i").collect()]


def test_sections_add_up(spark):
    df = spark.createDataFrame([([(i * 7919) % 2**62 - 2**61 for i in range(12)], [(i * 104729) % 2**62 for i in range(12)])], "a array<bigint>, b array<bigint>")
    r = df.select(B.section_distances(F.col("a"), F.col("b")).alias("s"), B.hamming(F.col("a"), F.col("b")).alias("d")).first()
    inside = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(*df.first()))
    assert r["d"] == inside
    full = "".join(format((x ^ y) & (2**64 - 1), "064b") for x, y in zip(*df.first()))
    assert [p["d"] for p in r["s"]] == [full[f : f + n].count("1") for _, f, n in B.SECTIONS]
