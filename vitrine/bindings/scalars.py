"""Scalar expressions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.bindings import base as T
from vitrine.bindings.reg import registrar
from vitrine.functions import bits as B
from vitrine.functions import scalar as S

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
c = F.col
NOW = lambda: F.lit("2024-02-01 12:00:00").cast("timestamp")


@query("e1_norm_name", r"""
SELECT p_partkey AS id,
       trim(regexp_replace(regexp_replace(lower(p_type || p_size || ': ' || p_brand || ' - ' || p_name),
            '^(sv|swsh|sm|xy|bw|hgss|dp|ex|me)\d*\s*:\s*', ''), '[^a-z0-9]+', ' ', 'g')) AS plain,
       trim(regexp_replace(regexp_replace(lower('SV' || p_size || ' : ' || p_name || '!'),
            '^(sv|swsh|sm|xy|bw|hgss|dp|ex|me)\d*\s*:\s*', ''), '[^a-z0-9]+', ' ', 'g')) AS stripped
FROM part""")
def _(spark, d):
    p = T.table(spark, d, "part")
    return p.select(
        c("p_partkey").alias("id"),
        S.norm_name(F.concat(c("p_type"), c("p_size").cast("string"), F.lit(": "), c("p_brand"), F.lit(" - "), c("p_name"))).alias("plain"),
        S.norm_name(F.concat(F.lit("SV"), c("p_size").cast("string"), F.lit(" : "), c("p_name"), F.lit("!"))).alias("stripped"),
    )


@query("e2_norm_number", r"""
SELECT p_partkey AS id,
       lower(regexp_replace(trim(split_part('00' || p_size || '/50', '/', 1)), '^([A-Za-z]*)0*(\d+)([A-Za-z]*)$', '\1\2\3')) AS padded,
       lower(regexp_replace(trim(split_part(' TG0' || p_size || 'B /TG50', '/', 1)), '^([A-Za-z]*)0*(\d+)([A-Za-z]*)$', '\1\2\3')) AS lettered,
       lower(regexp_replace(trim(split_part(p_name, '/', 1)), '^([A-Za-z]*)0*(\d+)([A-Za-z]*)$', '\1\2\3')) AS unmatched
FROM part""")
def _(spark, d):
    p = T.table(spark, d, "part")
    size = c("p_size").cast("string")
    return p.select(
        c("p_partkey").alias("id"),
        S.norm_number(F.concat(F.lit("00"), size, F.lit("/50"))).alias("padded"),
        S.norm_number(F.concat(F.lit(" TG0"), size, F.lit("B /TG50"))).alias("lettered"),
        S.norm_number(c("p_name")).alias("unmatched"),
    )


@query("e3_id_abbrevs", r"""
WITH x AS (SELECT DISTINCT lower(replace(p_brand, '#', '')) AS set_id FROM part),
y AS (SELECT set_id, upper(regexp_extract(set_id, '^([a-z]+)0*(\d+)', 1)) AS pre, regexp_extract(set_id, '^([a-z]+)0*(\d+)', 2) AS num FROM x)
SELECT DISTINCT set_id, unnest([pre || num, pre || CASE WHEN length(num) < 2 THEN '0' || num ELSE num END]) AS abbrev FROM y""")
def _(spark, d):
    p = T.table(spark, d, "part").select(F.lower(F.regexp_replace("p_brand", "#", "")).alias("set_id")).distinct()
    return p.select("set_id", F.explode(S.id_abbrevs(c("set_id"))).alias("abbrev"))


@query("e4_name_similarity")
def _(spark, d):
    p = T.table(spark, d, "part")
    return p.select("p_partkey", S.name_similarity(S.norm_name(c("p_name")), S.norm_name(c("p_type"))).alias("ratio"))


@query("e5_base_name", """
SELECT p_partkey AS id,
       CASE WHEN instr(n, ' (') > 1 THEN substr(n, 1, instr(n, ' (') - 1) ELSE n END AS base
FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' (' || p_brand || ') (x)' ELSE ' (' || p_name || ')' END AS n FROM part)""")
def _(spark, d):
    p = T.table(spark, d, "part")
    n = F.when(c("p_size") > 25, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") (x)"))).otherwise(
        F.concat(F.lit(" ("), "p_name", F.lit(")")))
    return p.select(c("p_partkey").alias("id"), S.base_name(n).alias("base"))


@query("e6_pile_key", "WITH " + T.PILE_LINES + " SELECT key, count(*) AS lines FROM lines GROUP BY key")
def _(spark, d):
    return T.pile_lines(spark, d).groupBy("key").agg(F.count("*").alias("lines"))


@query("e7_condition", "WITH " + T.PILE_LINES + """
SELECT condition, CASE condition WHEN 'NM' THEN 'Near Mint' WHEN 'LP' THEN 'Lightly Played' WHEN 'MP' THEN 'Moderately Played'
       WHEN 'HP' THEN 'Heavily Played' WHEN 'DM' THEN 'Damaged' ELSE 'Near Mint' END AS label,
       """ + T.MULT + """ AS multiplier, count(*) AS lines
FROM (SELECT CASE WHEN quantity > 40 THEN 'HP' WHEN quantity > 30 THEN 'MP' WHEN quantity > 20 THEN 'DM' WHEN quantity > 10 THEN '?' ELSE condition END AS condition FROM lines)
GROUP BY ALL""")
def _(spark, d):
    q = c("quantity")
    cond = F.when(q > 40, "HP").when(q > 30, "MP").when(q > 20, "DM").when(q > 10, "?").otherwise(c("condition"))
    return (
        T.pile_lines(spark, d).select(cond.alias("condition"))
        .select("condition", S.condition_label(c("condition")).alias("label"), S.condition_multiplier(c("condition")).alias("multiplier"))
        .groupBy("condition", "label", "multiplier").agg(F.count("*").alias("lines"))
    )


@query("e8_line_value", "WITH " + T.PILE_LINES + f"""
SELECT origin, condition, grader IS NOT NULL AS graded, {T.money_sum(T.LINE_VALUE)} AS value,
       {T.money_sum('unit_price * ' + T.MULT)} AS quoted
FROM lines GROUP BY ALL""")
def _(spark, d):
    graded = c("grader").isNotNull()
    return (
        T.pile_lines(spark, d)
        .withColumn("graded", graded)
        .groupBy("origin", "condition", "graded").agg(
            F.sum(S.money_exact(S.line_value(c("unit_price"), c("condition"), graded, c("quantity")))).cast("double").alias("value"),
            F.sum(S.money_exact(S.quote_price(c("unit_price"), c("condition")))).cast("double").alias("quoted"),
        )
    )


@query("e9_grade_label", """
SELECT p_partkey AS id, 'BGS ' || CASE WHEN s = floor(s) THEN CAST(CAST(s AS BIGINT) AS VARCHAR) ELSE printf('%.1f', s) END AS label
FROM (SELECT p_partkey, p_size / 5.0::DOUBLE AS s FROM part)""")
def _(spark, d):
    return T.table(spark, d, "part").select(
        c("p_partkey").alias("id"), S.grade_label(F.lit("BGS"), c("p_size") / 5.0).alias("label"))


@query("e10_day_of", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    e = T.table(spark, d, "events")
    return e.groupBy(S.day_of(c("ts")).alias("day")).agg(F.count("*").alias("n"))


_UPDATED = lambda: F.when(F.col("event_type") == "error", F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(
    F.date_format(F.date_sub(F.to_date("ts"), F.floor(F.col("value")).cast("int")), "yyyy-MM-dd"))
_UPDATED_SQL = """SELECT event_id, CASE WHEN event_type = 'error' THEN 'x' || event_id ELSE
  strftime(CAST(ts AS DATE) - CAST(floor(value) AS INT), '%Y-%m-%d') END AS updated FROM events"""


@query("e11_days_old", f"""
SELECT event_id, CAST(date_diff('day', try_cast(updated AS DATE), DATE '2024-02-01') AS BIGINT) AS days FROM ({_UPDATED_SQL})""")
def _(spark, d):
    return T.table(spark, d, "events").select("event_id", S.days_old(_UPDATED(), NOW()).alias("days"))


@query("e12_freshness_label", f"""
SELECT event_id, CASE WHEN days IS NULL THEN 'updated ' || updated WHEN days <= 0 THEN 'updated today' WHEN days = 1 THEN 'updated yesterday'
  WHEN days < 30 THEN 'updated ' || days || ' days ago'
  ELSE 'updated ' || CAST(floor(days / 30 + 0.5) AS BIGINT) || CASE WHEN floor(days / 30 + 0.5) = 1 THEN ' month ago' ELSE ' months ago' END END AS label
FROM (SELECT event_id, updated, date_diff('day', try_cast(updated AS DATE), DATE '2024-02-01') AS days FROM ({_UPDATED_SQL}))""")
def _(spark, d):
    return T.table(spark, d, "events").select("event_id", S.freshness_label(_UPDATED(), NOW()).alias("label"))


@query("e13_is_stale", f"""
SELECT event_id, coalesce(date_diff('day', try_cast(updated AS DATE), DATE '2024-02-01') > 10, true) AS stale FROM ({_UPDATED_SQL})""")
def _(spark, d):
    return T.table(spark, d, "events").select("event_id", S.is_stale(_UPDATED(), NOW()).alias("stale"))


@query("e14_short_day", f"""
SELECT event_id, coalesce(strftime(try_cast(updated AS DATE), '%-d %b'), updated) AS label FROM ({_UPDATED_SQL})""")
def _(spark, d):
    return T.table(spark, d, "events").select("event_id", S.short_day(_UPDATED()).alias("label"))


_MONEY_SQL = """CASE WHEN v IS NULL THEN '—' WHEN v > 0 AND v < 0.005 THEN '<$0.01' ELSE '$' || format('{:,.2f}', v) END"""


@query("e15_money_labels", f"""
SELECT o_orderkey AS id, {_MONEY_SQL} AS label,
       CASE WHEN v >= 100000 THEN '$' || CAST(floor(v / 1000 + 0.5) AS BIGINT) || 'k'
            WHEN v >= 10000 THEN '$' || printf('%.1f', floor(v / 100 + 0.5) / 10) || 'k' ELSE {_MONEY_SQL} END AS short
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN NULL WHEN o_totalprice < 60000 THEN o_totalprice / 100000000
      ELSE o_totalprice END AS v FROM orders)""")
def _(spark, d):
    v = F.when((c("o_orderstatus") == "P") & (c("o_totalprice") < 50000), F.lit(None)).when(
        c("o_totalprice") < 60000, c("o_totalprice") / 100000000).otherwise(c("o_totalprice"))
    return T.table(spark, d, "orders").select(
        c("o_orderkey").alias("id"), S.money_label(v).alias("label"), S.money_short(v).alias("short"))


@query("e16_rarity_tier", """
SELECT tier, count(*) AS n FROM (SELECT CASE WHEN r IS NULL OR r = '' THEN 'none'
  WHEN contains(r, 'secret') OR contains(r, 'hyper') OR contains(r, 'rainbow') THEN 'secret'
  WHEN contains(r, 'illustration') OR contains(r, 'star') OR contains(r, 'shiny') THEN 'illustration'
  WHEN contains(r, 'ultra') OR contains(r, 'vmax') OR contains(r, 'vstar') OR contains(r, 'ex') THEN 'ultra'
  WHEN contains(r, 'double') OR contains(r, 'holo') THEN 'double' WHEN contains(r, 'rare') THEN 'rare'
  WHEN contains(r, 'uncommon') THEN 'uncommon' WHEN contains(r, 'promo') THEN 'promo' ELSE 'other' END AS tier
FROM (SELECT lower(text) AS r FROM documents UNION ALL SELECT lower(p_name || p_type) FROM part)) GROUP BY tier""")
def _(spark, d):
    both = T.table(spark, d, "documents").select("text").unionAll(
        T.table(spark, d, "part").select(F.concat("p_name", "p_type")))
    return both.groupBy(S.rarity_tier(c("text")).alias("tier")).agg(F.count("*").alias("n"))


@query("e17_clean_label", r"SELECT page_id, substr(trim(regexp_replace(html, '\s+', ' ', 'g')), 1, 40) AS label FROM pages")
def _(spark, d):
    return T.table(spark, d, "pages").select("page_id", S.clean_label(c("html")).alias("label"))


@query("e18_product_url", """
SELECT p_partkey AS id, 'https://www.tcgplayer.com/product/' || CASE WHEN p_size > 10 THEN p_partkey END AS url FROM part""")
def _(spark, d):
    return T.table(spark, d, "part").select(
        c("p_partkey").alias("id"), S.product_url(F.when(c("p_size") > 10, c("p_partkey"))).alias("url"))


@query("e19_safe_file_name", r"""
SELECT p_partkey AS id, regexp_replace(p_brand || '/' || p_name || '-' || p_partkey, '[^A-Za-z0-9_-]', '_', 'g') || '.png' AS file FROM part""")
def _(spark, d):
    return T.table(spark, d, "part").select(
        c("p_partkey").alias("id"),
        S.safe_file_name(F.concat("p_brand", F.lit("/"), "p_name", F.lit("-"), c("p_partkey").cast("string"))).alias("file"))


@query("e20_asset_urls", """
SELECT p_partkey AS id, 'https://images.pokemontcg.io/' || p_brand || '/' || p_size || '.png' AS image,
  'https://images.pokemontcg.io/' || p_brand || '/' || p_size || '_hires.png' AS image_hires,
  'https://images.pokemontcg.io/' || p_brand || '/symbol.png' AS symbol, 'https://images.pokemontcg.io/' || p_brand || '/logo.png' AS logo FROM part""")
def _(spark, d):
    return T.table(spark, d, "part").select(
        c("p_partkey").alias("id"), S.asset_urls(c("p_brand"), c("p_size").cast("string")).alias("u")).select("id", "u.*")


@query("e21_diff_bits", "WITH " + T.FP + """, g AS (
  SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT fp.row_id, CAST(diffs AS VARCHAR) AS bits,
  array_to_string(list_concat(
    list_transform(list_filter(range(0, 64), lambda i: i % 8 < 7), lambda i: CAST(e[i + 2] > e[i + 1] AS INT)),
    list_transform(range(0, 56), lambda i: CAST(e[i + 9] > e[i + 1] AS INT))), '') AS grid_bits
FROM fp JOIN g USING (row_id)""")
def _(spark, d):
    e = T.table(spark, d, "embeddings")
    v = c("embedding").cast("array<double>")
    text = lambda x: F.array_join(x.cast("array<string>"), "")
    return e.select(
        c("vec_id").alias("row_id"), text(B.diff_bits(v)).alias("bits"), text(B.grid_diff_bits(v, 8, 8)).alias("grid_bits"))


@query("e22_median_bits", "WITH " + T.FP + " SELECT row_id, CAST(strip AS VARCHAR) AS bits FROM fp")
def _(spark, d):
    e = T.table(spark, d, "embeddings")
    bits = B.median_bits(c("embedding").cast("array<double>"))
    return e.select(c("vec_id").alias("row_id"), F.array_join(bits.cast("array<string>"), "").alias("bits"))


@query("e23_pack_bits", "WITH " + T.FP + """
SELECT row_id, CAST(bits AS VARCHAR) AS unpacked, CAST(get_bit(bits, 70) AS BIGINT) AS bit_70 FROM fp""")
def _(spark, d):
    fp = T.fingerprints(spark, d)
    return fp.select(
        "row_id", F.array_join(B.unpack_bits(c("desc"), T.FP_BITS).cast("array<string>"), "").alias("unpacked"),
        B.bit_at(c("desc"), 70).cast("bigint").alias("bit_70"))


@query("e24_hamming", "WITH " + T.FP + """
SELECT a.row_id, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS distance
FROM fp a JOIN fp b ON b.row_id = a.row_id + 1""")
def _(spark, d):
    fp = T.fingerprints(spark, d)
    nxt = fp.select((c("row_id") - 1).alias("row_id"), c("desc").alias("other"))
    return fp.join(nxt, "row_id").select("row_id", B.hamming(c("desc"), c("other")).cast("bigint").alias("distance"))


@query("e25_section_distances", "WITH " + T.FP + """, p AS (
  SELECT a.row_id, xor(a.diffs, b.diffs) AS x, xor(a.strip, b.strip) AS y FROM fp a JOIN fp b ON b.row_id = a.row_id + 1)
SELECT row_id, 'diff' AS name, CAST(bit_count(x) AS BIGINT) AS d, CAST(63 AS BIGINT) AS "of" FROM p
UNION ALL SELECT row_id, 'median', CAST(bit_count(y) AS BIGINT), 64 FROM p""")
def _(spark, d):
    fp = T.fingerprints(spark, d)
    nxt = fp.select((c("row_id") - 1).alias("row_id"), c("desc").alias("other"))
    parts = B.section_distances(c("desc"), c("other"), T.FP_SPANS, T.FP_WORDS)
    return fp.join(nxt, "row_id").select("row_id", F.inline(parts))


@query("e26_match_confidence", """
SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1 - value / 742.0::DOUBLE * 2.2::DOUBLE) * (0.55::DOUBLE + 0.45::DOUBLE *
  CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, CAST(user_id AS DOUBLE) / 40.0::DOUBLE) END))) AS confidence FROM events""")
def _(spark, d):
    e = T.table(spark, d, "events")
    return e.select("event_id", S.match_confidence(c("value"), c("user_id").cast("double"), c("event_type") == "view").alias("confidence"))


@query("e27_to_luma", """
SELECT l_orderkey, l_linenumber, l_suppkey, CAST(floor(0.299::DOUBLE * (l_partkey % 256) + 0.587::DOUBLE * (l_suppkey % 256) + 0.114::DOUBLE * (l_orderkey % 256)) AS BIGINT) AS luma
FROM lineitem""")
def _(spark, d):
    li = T.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_suppkey",
                     S.to_luma(c("l_orderkey") % 256, c("l_suppkey") % 256, c("l_partkey") % 256).cast("bigint").alias("luma"))


_ALLOW_DOC = lambda: F.concat(
    F.lit('{"pro":'), F.when(c("event_type") == "purchase", "true").when(c("event_type") == "view", '"true"').otherwise("false"),
    F.lit(',"freeLeft":'), F.floor("value").cast("string"), F.lit(',"credits":'),
    F.when(c("event_type") == "error", "-5").otherwise(F.concat(F.lit("1"), c("user_id").cast("string"), F.lit(".75"))),
    F.lit(',"adsToday":'), F.when(c("event_type") == "click", '"4"').otherwise("9"),
    F.lit(',"freeDay":'), F.when(c("event_type") == "signup", "12").otherwise('"2024-01-05"'), F.lit(',"scansEver":'),
    c("event_id").cast("string"), F.when(c("event_type") == "error", "").otherwise("}"))


@query("e28_repair_allowance", """
SELECT event_id, coalesce(event_type = 'purchase', false) AS pro,
  CAST(CASE WHEN event_type = 'error' THEN 30 ELSE least(floor(value), 30) END AS BIGINT) AS free_left,
  CASE WHEN event_type IN ('signup', 'error') THEN '2024-02-01' ELSE '2024-01-05' END AS free_day,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE CAST('1' || user_id AS BIGINT) END AS BIGINT) AS credits,
  CAST(CASE WHEN event_type IN ('click', 'error') THEN 0 ELSE 5 END AS BIGINT) AS ads_today,
  '2024-02-01' AS ads_day, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE event_id END AS BIGINT) AS scans_ever, CAST(0 AS BIGINT) AS credits_ever
FROM events""")
def _(spark, d):
    e = T.table(spark, d, "events")
    return e.select("event_id", S.repair_allowance(_ALLOW_DOC(), NOW()).alias("a")).select("event_id", "a.*")


@query("e29_repair_snapshot", """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS entries,
       CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS quantity,
       CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS BIGINT) AS removed, CAST(0 AS BIGINT) AS wants FROM orders""")
def _(spark, d):
    o = T.table(spark, d, "orders")
    doc = F.concat(
        F.lit('{"entries":'),
        F.when(c("o_orderstatus") == "F", F.concat(F.lit('[{"key":"k","quantity":'), c("o_custkey").cast("string"), F.lit("}]"))).otherwise('{"key":1}'),
        F.lit(',"wishlist":7,"removed":'),
        F.when(c("o_orderstatus") == "P", "[1,2]").otherwise(F.concat(F.lit('{"k":'), c("o_orderkey").cast("string"), F.lit("}"))),
        F.lit("}"))
    return o.select(c("o_orderkey").alias("id"), S.repair_snapshot(doc).alias("s")).select(
        "id", F.size("s.entries").cast("bigint").alias("entries"), F.get(c("s.entries"), F.lit(0))["quantity"].alias("quantity"),
        F.size("s.removed").cast("bigint").alias("removed"), F.size("s.wishlist").cast("bigint").alias("wants"))


@query("e30_set_of_card_id", r"""
SELECT p_partkey AS id, regexp_replace(CASE WHEN p_size > 20 THEN replace(p_type, ' ', '-') || '-' || p_partkey ELSE p_type END, '-[^-]*$', '') AS set_id FROM part""")
def _(spark, d):
    p = T.table(spark, d, "part")
    card = F.when(c("p_size") > 20, F.concat(F.regexp_replace("p_type", " ", "-"), F.lit("-"), c("p_partkey").cast("string"))).otherwise(c("p_type"))
    return p.select(c("p_partkey").alias("id"), S.set_of_card_id(card).alias("set_id"))
