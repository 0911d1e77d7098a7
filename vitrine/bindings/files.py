"""Readers and writers over files that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.bindings import base as T
from vitrine.bindings.matching import products
from vitrine.bindings.reg import registrar
from vitrine.functions import bits as B
from vitrine.functions import scalar as S
from vitrine.session import let_go, shared_path
from vitrine.sources import catalogue as SC
from vitrine.sources import exports as SX
from vitrine.sources import fingerprints as SF
from vitrine.sources import images as SI
from vitrine.sources import library as SL

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
c = F.col
AT = lambda: F.lit("2024-02-01 00:00:00").cast("timestamp")


def _arrays(df, folder, key, struct, path):
    """One JSON array per key and thousand rows, in a folder named after the key."""
    part = F.floor(c("_n") / 1000)
    rows = df.withColumn("_part", part).groupBy(key, "_part").agg(F.to_json(F.collect_list(struct)).alias("value"))
    rows.select("value", F.concat(c(key).cast("string"), F.lit(".json")).alias(folder)).repartition(folder).write.mode("overwrite").option(
        "maxRecordsPerFile", 1).partitionBy(folder).text(path)


@query("s1_read_catalogue", """
SELECT CAST(p_partkey AS VARCHAR) AS card_id, p_name AS name, CASE WHEN p_size > 10 THEN p_type END AS rarity, lower(replace(p_brand, '#', '')) AS set_id,
  CAST(CASE WHEN p_size > 25 THEN 2 ELSE 0 END AS BIGINT) AS subtypes, b.released FROM part JOIN (
  SELECT p_brand, DATE '1999-01-01' + CAST(min(p_partkey) AS INT) AS released FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1) b USING (p_brand)""")
def _(spark, d):
    path = shared_path(spark, "catalogue")
    part = T.table(spark, d, "part").withColumn("set_id", F.lower(F.regexp_replace("p_brand", "#", ""))).withColumn("_n", c("p_partkey"))
    card = F.struct(
        c("p_partkey").cast("string").alias("id"), c("p_name").alias("name"), c("p_size").cast("string").alias("number"),
        F.when(c("p_size") > 10, c("p_type")).alias("rarity"), F.when(c("p_size") > 25, F.array(F.lit("a"), F.lit("b"))).alias("subtypes"))
    _arrays(part, "file", "set_id", card, path + "/cards")
    # one brand's set is unknown, so its file is dropped
    sets = part.filter(c("set_id") != "brand3").groupBy("set_id").agg(F.min("p_partkey").alias("k")).withColumn("_n", F.lit(0)).withColumn("all", F.lit("sets"))
    _arrays(sets, "file", "all", F.struct(
        c("set_id").alias("id"), c("set_id").alias("name"), F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), c("k").cast("int")), "yyyy/MM/dd").alias("releaseDate")),
        path + "/sets")
    sets, cards = SC.read_catalogue(spark, path + "/sets/*", path + "/cards/*")
    return cards.join(sets.select("set_id", "released"), "set_id").select(
        "card_id", "name", "rarity", "set_id", F.size("subtypes").cast("bigint").alias("subtypes"), "released")


@query("s2_read_product_feed", """
WITH p AS (SELECT DISTINCT l_suppkey AS group_id, l_partkey * 10000000 + l_suppkey AS product_id, CASE WHEN p_size > 2 THEN CAST(p_partkey AS VARCHAR) || '/50' END AS number,
  CASE WHEN p_type = 'PROMO' THEN 'Code Card' ELSE p_type END AS rarity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 0)
SELECT 'product' AS kind, group_id, product_id, number, rarity FROM p
UNION ALL SELECT 'bad', s_suppkey, NULL, NULL, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT group_id FROM p)""")
def _(spark, d):
    path = shared_path(spark, "feed")
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    p = products(spark, d).withColumn("extendedData", F.filter(
        F.array(pair("Number", c("number")), pair("Rarity", c("rarity")), pair("Other", F.lit("x"))), lambda x: x["value"].isNotNull()))
    groups = T.table(spark, d, "supplier").select(c("s_suppkey").alias("group_id"), (c("s_acctbal") < 0).alias("broken"))
    item = F.struct(c("product_id").alias("productId"), "name", "url", "extendedData")
    # A file holds about a thousand products of a group, so files follow the groups, not the products.
    parts = p.groupBy("group_id").agg(F.ceil(F.count("*") / 1000).alias("_parts"))
    of_group = F.pmod(F.xxhash64("product_id"), c("_parts"))
    docs = p.join(groups, "group_id").join(parts, "group_id").withColumn("_part", of_group).groupBy("group_id", "broken", "_part").agg(
        F.to_json(F.struct(F.lit(True).alias("success"), F.collect_list(item).alias("results"))).alias("doc"))
    # Documents say much the same again and again: compressed they take a tenth. Each is a file of its own wherever it was made.
    docs.select(F.when(c("broken"), F.substring("doc", 1, 40)).otherwise(c("doc")).alias("value"), F.concat(c("group_id").cast("string"), F.lit(".json")).alias("file")).write.mode(
        "overwrite").option("maxRecordsPerFile", 1).option("compression", "gzip").partitionBy("file").text(path)
    let_go(spark)
    good, bad = SC.read_product_feed(spark, groups.select("group_id"), path + "/*")
    null = lambda kind: F.lit(None).cast(kind)
    return good.select(F.lit("product").alias("kind"), "group_id", "product_id", "number", "rarity").unionByName(
        bad.select(F.lit("bad").alias("kind"), "group_id", null("bigint").alias("product_id"), null("string").alias("number"), null("string").alias("rarity")))


@query("s5_read_fingerprint_file", "WITH " + T.FP + """
SELECT row_id // 128 AS file, row_id % 128 AS row_id, CAST(bits AS VARCHAR) AS bits, CAST(strip AS VARCHAR) AS strip FROM fp""")
def _(spark, d):
    fp = T.fingerprints(spark, d)
    row_hex = F.array_join(F.transform("rows", lambda r: r["d"]), "")
    strip_hex = F.array_join(F.transform("rows", lambda r: r["s"]), "")
    little = lambda v, n: F.array_join(F.reverse(F.transform(F.sequence(F.lit(1), F.lit(2 * n), F.lit(2)), lambda i: F.substring(F.lpad(F.hex(v), 2 * n, "0"), i, F.lit(2)))), "")
    files = (
        fp.groupBy(F.floor(c("row_id") / 128).alias("file")).agg(F.array_sort(F.collect_list(F.struct(
            "row_id", F.hex(B.words_to_binary(c("desc"), 2, 16)).alias("d"), F.hex(B.words_to_binary(c("strip"), 1, 8)).alias("s")))).alias("rows"))
        .select("file", F.unhex(F.concat(
            F.hex(F.lit(b"PKSC")), little(F.lit(2), 2), little(F.lit(127), 2), little(F.lit(16), 2), little(F.size("rows"), 4), little(F.lit(64), 2),
            little(F.lit(8), 2), row_hex, strip_hex)).alias("content")))
    rows = SF.parse_fingerprints(files, 16, 8)
    text = lambda words, n: F.array_join(B.unpack_bits(words, n).cast("array<string>"), "")
    return rows.select(
        "file", "row_id", text(B.words_from_binary(c("desc"), 16), 127).alias("bits"), text(B.words_from_binary(c("strip"), 8), 64).alias("strip"))


_FIXED = lambda x: f"CAST(CAST(CAST({x} AS DECIMAL(24,6)) AS DECIMAL(24,2)) AS VARCHAR)"


@query("s10_export_piles_csv", "WITH " + T.PILES + f"""
SELECT CAST(quantity AS VARCHAR) AS "Quantity", CASE WHEN quantity > 20 THEN 'a "b", c' ELSE name END AS "Name", set_name AS "Set", number AS "Number", rarity AS "Rarity", variant AS "Variant",
  CASE WHEN grader IS NOT NULL THEN 'Near Mint' WHEN condition = 'NM' THEN 'Near Mint' ELSE 'Lightly Played' END AS "Condition",
  CASE WHEN grader IS NOT NULL THEN grader || ' ' || CASE WHEN score = 10 THEN '10' ELSE '9.5' END END AS "Grade",
  {_FIXED('unit_price')} AS "Unit Price (NM)", {_FIXED(T.LINE_VALUE)} AS "Line Value" FROM piles""")
def _(spark, d):
    path = shared_path(spark, "piles-csv")
    p = T.piles(spark, d).withColumn("name", F.when(c("quantity") > 20, 'a "b", c').otherwise(c("name")))
    SX.export_piles_csv(p, path)
    return SX.read_csv_back(spark, path, SX.PILE_HEADER)


@query("s11_export_session_csv", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS card_id, event_type AS name, {_FIXED("CASE WHEN event_type <> 'error' THEN value END")} AS market_usd,
  CASE WHEN value > 100 THEN 'yes' END AS needs_check FROM events
UNION ALL SELECT NULL, NULL, 'TOTAL', CAST(sum(CAST(CASE WHEN event_type <> 'error' THEN value END AS DECIMAL(20,2))) AS VARCHAR), NULL FROM events""")
def _(spark, d):
    path = shared_path(spark, "session-csv")
    e = T.table(spark, d, "events").select(
        c("ts").alias("scanned_at"), c("event_id").alias("seq"), c("user_id").alias("card_id"), c("event_type").alias("name"), F.lit("s").alias("set_name"),
        F.lit("1").alias("number"), F.lit(None).cast("string").alias("rarity"), F.lit("Normal").alias("variant"),
        F.when(c("event_type") != "error", c("value")).alias("price"), F.lit(None).cast("string").alias("url"), (c("value") > 100).alias("ambiguous"))
    SX.export_session_csv(e, path)
    back = SX.read_csv_back(spark, path, SX.SESSION_HEADER)
    return back.select(F.substring("scanned_at", 1, 10).alias("day"), "card_id", "name", "market_usd", "needs_check")


def _docs(spark, d):
    """Orders as library documents: F is version 2, O version 1, P is junk of several kinds."""
    o = T.table(spark, d, "orders")
    key = c("o_orderkey").cast("string")
    v2 = F.concat(
        F.lit('{"version":2,"activeId":"'), F.when(c("o_orderpriority") == "1-URGENT", F.concat(F.lit("b"), key)).otherwise("nope"),
        F.lit('","collections":[{"id":"a'), key, F.lit('","name":"  My   box ","entries":[{"key":"k","quantity":'), c("o_custkey").cast("string"),
        F.lit('}],"createdAt":5},{"id":"b'), key, F.lit('","name":"","entries":7},{"id":3}]}'))
    v1 = F.concat(F.lit('{"version":1,"entries":[{"key":"k","quantity":1},{"key":"l","quantity":2}],"wishlist":'),
                  F.when(c("o_custkey") > 500, "[]").otherwise('"x"'), F.lit("}"))
    junk = F.when(c("o_orderpriority") == "5-LOW", F.lit("not json")).otherwise(F.lit('{"version":2,"collections":[]}'))
    return o.select(c("o_orderkey").alias("owner"), F.when(c("o_orderstatus") == "F", v2).when(c("o_orderstatus") == "O", v1).otherwise(junk).alias("body"))


@query("s13_load_library", """
SELECT o_orderkey AS owner, 'a' || o_orderkey AS collection_id, 'My box' AS name, CAST(1 AS BIGINT) AS entries, CAST(5 AS BIGINT) AS created_at, CASE WHEN o_orderpriority = '1-URGENT' THEN 'b' ELSE 'a' END || o_orderkey AS active_id FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'b' || o_orderkey, 'Untitled', 0, 1706745600000, CASE WHEN o_orderpriority = '1-URGENT' THEN 'b' ELSE 'a' END || o_orderkey FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_orderkey || '-1', 'My collection', CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END, 1706745600000, o_orderkey || '-1' FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT o_orderkey, NULL, 'quarantined', NULL, NULL, NULL FROM orders WHERE o_orderstatus = 'P'""")
def _(spark, d):
    collections, active, quarantine = SL.load_library(_docs(spark, d), AT())
    rows = collections.join(active, "owner").select(
        "owner", "collection_id", "name", F.size("entries").cast("bigint").alias("entries"), "created_at", "active_id")
    return rows.unionByName(quarantine.select("owner", F.lit("quarantined").alias("name")), allowMissingColumns=True)


def _documents_table(spark, d, *statuses):
    return T.table(spark, d, "orders").filter(c("o_orderstatus").isin(*statuses)).select(
        (c("o_custkey") % 10).alias("user_id"), F.floor(c("o_orderkey") / 2).alias("collection_id"), c("o_totalprice").alias("body")).groupBy(
        "user_id", "collection_id").agg(F.max("body").alias("body"))


def _docs_sql(*statuses):
    status = "', '".join(statuses)
    return f"SELECT o_custkey % 10 AS user_id, o_orderkey // 2 AS collection_id, max(o_totalprice) AS body FROM orders WHERE o_orderstatus IN ('{status}') GROUP BY 1, 2"


@query("s14_save_collections", f"""
WITH old AS ({_docs_sql('F', 'P')}), new AS ({_docs_sql('O')})
SELECT user_id, collection_id, body FROM old WHERE user_id NOT IN (SELECT user_id FROM new) OR collection_id NOT IN (SELECT collection_id FROM new) UNION ALL SELECT * FROM new""")
def _(spark, d):
    path = shared_path(spark, "collections")
    _documents_table(spark, d, "F", "P").write.partitionBy("user_id").parquet(path)
    SL.save_collections(_documents_table(spark, d, "O"), path)
    return spark.read.schema("collection_id BIGINT, body DOUBLE, user_id BIGINT").parquet(path)


@query("s15_erase_owner", f"""
WITH t AS ({_docs_sql('F', 'O', 'P')})
SELECT 'before' AS state, count(*) FILTER (user_id = 7) AS owned, count(*) FILTER (user_id <> 7) AS others FROM t UNION ALL SELECT 'after', 0, count(*) FILTER (user_id <> 7) FROM t""")
def _(spark, d):
    path = shared_path(spark, "owners")
    table = _documents_table(spark, d, "F", "O", "P")
    table.write.partitionBy("user_id").parquet(path)
    SL.erase_stored_owner(spark, path, 7, "user_id")
    kept = spark.read.schema("collection_id BIGINT, body DOUBLE, user_id BIGINT").parquet(path)
    return SL.erasure_report(table, kept, 7)


@query("s19_read_images")
def _(spark, d):
    """Pages as 24-bit BMP files of 24 x 32 pixels; every page without a title is cut short."""
    path = shared_path(spark, "images")
    size = 24 * 32 * 3
    header = bytes.fromhex("424d") + (54 + size).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (
        24).to_bytes(4, "little") + (32).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + size.to_bytes(4, "little") + bytes(16)
    times = (F.floor(F.lit(size) / F.octet_length("html")) + 1).cast("int")
    pixels = F.substring(F.encode(F.repeat(c("html"), times), "utf-8"), 1, size)
    whole = F.concat(F.lit(header), pixels)
    pages = T.table(spark, d, "pages").filter(F.octet_length("html") > 0).select(
        F.concat(c("page_id").cast("string"), F.lit(".bmp")).alias("name"),
        F.when(F.lower("html").contains("<title"), whole).otherwise(F.substring(whole, 1, 20)).alias("content"))
    # One file a page: pages are dealt to all tasks, however few files the table has.
    written = SI.write_files(pages.repartition("name"), path).agg(F.sum("bytes").alias("b")).first()
    if not written["b"]:
        raise ValueError("no images were written")
    wanted = T.table(spark, d, "pages").select(F.explode(F.array(c("page_id"), -c("page_id") - 1).cast("array<string>")).alias("image_id"))
    return SI.image_states(spark, path, wanted).select("image_id", F.coalesce("reason", F.lit("decoded")).alias("state"), F.md5("data").alias("pixels"))


@query("compact_catalogue", "SELECT p_partkey AS row_id, CAST(p_partkey AS VARCHAR) AS card_id, p_name AS name, 'set ' || (p_partkey // 1000) AS set_name FROM part")
def _(spark, d):
    """A compact positional document per thousand cards."""
    path = shared_path(spark, "compact")
    row = F.array(c("p_partkey").cast("string"), "p_name", c("p_size").cast("string"), "p_type", F.lit("0"), c("p_partkey").cast("string"))
    part = T.table(spark, d, "part").withColumn("chunk", F.floor(c("p_partkey") / 1000))
    doc = part.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("x")).select(F.to_json(F.struct(
        F.array(F.array(c("chunk").cast("string"), F.concat(F.lit("set "), c("chunk").cast("string")), F.lit("2020/01/01"))).alias("sets"),
        F.transform("x", lambda y: y["r"]).alias("cards"))).alias("value"), "chunk")
    doc.repartition("chunk").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("chunk").text(path)
    back = SC.read_compact_catalogue(spark, path + "/*")
    return back.select((F.regexp_extract("set_name", r"(\d+)", 1).cast("bigint") * 1000 + c("row_id")).alias("row_id"), "card_id", "name", "set_name")
