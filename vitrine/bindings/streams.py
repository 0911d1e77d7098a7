"""Streaming operators over the driver's events, replayed as files.

A stream is drained into a table and read back, so its result can be compared
like any other. The batch twins run over the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.bindings import base as T
from vitrine.bindings.fingerprint import AMBIGUOUS, BAND, DECISIVE, GATE, names
from vitrine.bindings.pricing import WANTS, wants
from vitrine.bindings.reg import registrar
from vitrine.functions import bits as B
from vitrine.operators import piles as L
from vitrine.operators.book import manifest
from vitrine.session import settle, settle_by, shared_path
from vitrine.streaming import allowance as AL
from vitrine.streaming import confirm as CF
from vitrine.streaming import ledger as LG
from vitrine.streaming import live as LV
from vitrine.streaming import refresh as RF
from vitrine.streaming import sessions as SE

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
c = F.col
BY_FRAME = lambda: F.floor(F.col("frame_no") / 2000)


def scan_log(spark, d):
    """Events as reads: errors are blanks, expensive ones are refused, the value's tenth names the item."""
    e = T.table(spark, d, "events")
    return e.select(
        c("user_id").alias("device"), c("event_id").alias("frame_no"), c("ts").cast("timestamp").alias("ts"),
        (c("event_type") != "error").alias("detected"), ((c("event_type") != "error") & (c("value") < 60)).alias("accepted"),
        F.floor(c("value") / 20).alias("best_id"), c("value").alias("best_distance"),
        (F.floor(c("value") / 20) + 1).alias("runner_id"), F.floor(c("value")).cast("bigint").alias("margin"),
        F.lit(False).alias("reused"))


def _stream(spark, df, name, key="device", order="frame_no"):
    """Time-ordered files of two writers each, at least four micro-batches."""
    return SE.replay_in_order(df, shared_path(spark, name), key, order)


@query("w11_confirm_hits_batch")
def _(spark, d):
    return CF.confirm_hits_batch(scan_log(spark, d), BY_FRAME(), confirm=2, cooldown=400)


@query("g1_confirm_hits")
def _(spark, d):
    hits = CF.confirm_hits(CF.drop_late(_stream(spark, scan_log(spark, d), "reads"), "1 hour"), confirm=2, cooldown=400)
    return SE.run_to_end(hits, shared_path(spark, "hits"))


@query("g11_mark_emitted")
def _(spark, d):
    log = scan_log(spark, d)
    manual = log.filter(c("best_distance") > 200).select("device", "frame_no", "ts", c("best_id").alias("confirmed_id"))
    return CF.confirm_hits_batch(CF.mark_emitted(log, manual), BY_FRAME(), confirm=2, cooldown=400)


@query("g11_mark_emitted_live")
def _(spark, d):
    """Reads and confirmations as two streams of other pace; a last beat of both lets the watermark pass every line."""
    log = scan_log(spark, d).withColumn("ts", F.timestamp_seconds("frame_no"))
    manual = log.filter(c("best_distance") > 200).select("device", "frame_no", "ts", c("best_id").alias("confirmed_id"))
    beat = log.agg((F.max("frame_no") + 20_000).alias("frame_no")).filter("frame_no is not null").select(
        F.lit(-1).cast("bigint").alias("device"), "frame_no", F.timestamp_seconds("frame_no").alias("ts"))
    paced = lambda df, name, batches: SE.replay_in_order(
        df.unionByName(beat, allowMissingColumns=True), shared_path(spark, name), "device", "frame_no", batches)
    both = CF.mark_emitted_live(paced(log, "reads", 4), paced(manual, "manual", 2), "1 hour", "2 hours")
    return SE.run_to_end(CF.confirm_in_order(both, confirm=2, cooldown=400), shared_path(spark, "hits"))


@query("g2_reuse_unchanged")
def _(spark, d):
    log = scan_log(spark, d).withColumn("area", c("best_distance") + 20).withColumn(
        "signature", F.array(*[F.floor(c("best_distance") / k).cast("float") for k in (4, 8, 16, 32)]))
    return SE.run_to_end(CF.reuse_unchanged(CF.drop_late(_stream(spark, log, "views"), "1 hour"), size_tol=0.5, level=6.0), shared_path(spark, "reused"))


def print_log(spark, d):
    """Fingerprints as a frame log of the label's device; some frames are blank."""
    e = T.table(spark, d, "embeddings").select("vec_id", F.element_at("embedding", 1).alias("x"))
    fp = T.fingerprints(spark, d).join(e, c("row_id") == c("vec_id"))
    return fp.select(
        c("label").alias("device"), c("row_id").alias("frame_no"), (c("x") > -0.1).alias("detected"), (c("x") > 0.2).alias("flipped"), "desc")


@query("g3_vote_frames")
def _(spark, d):
    voted = CF.vote_frames(_stream(spark, print_log(spark, d), "prints"), n=5, max_drift=64)
    return SE.run_to_end(voted, shared_path(spark, "voted")).select("device", "frame_no", "depth", F.hex(B.words_to_binary(c("desc"), 2, 16)).alias("desc"))


@query("g3_vote_frames_batch")
def _(spark, d):
    out = CF.vote_frames_batch(print_log(spark, d), F.floor(c("frame_no") / 100), 2, n=5, max_drift=64)
    return out.select("device", "frame_no", "depth", F.hex(B.words_to_binary(c("desc"), 2, 16)).alias("desc"))


def live_frames(spark, d):
    """The print log as frames with a footer and a view upside down: the vector read backwards."""
    values = F.reverse(F.col("embedding").cast("array<double>"))
    turned = T.table(spark, d, "embeddings").select(
        c("vec_id").alias("frame_no"), B.pack_bits(F.concat(B.diff_bits(values), B.median_bits(values)), T.FP_BITS).alias("turned_desc"),
        B.pack_bits(B.median_bits(values), 64).alias("turned_strip"))
    footers = T.fingerprints(spark, d).select(c("row_id").alias("frame_no"), "strip")
    look = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: B.bit_at(c("desc"), i).cast("double") * 100)
    log = print_log(spark, d).drop("flipped").join(turned, "frame_no").join(footers, "frame_no")
    return log.withColumns({"ts": F.timestamp_seconds("frame_no"), "area": F.lit(1.0), "signature": look})


@query("p3_live_hits")
def _(spark, d):
    retail = T.cards(spark, d).select(c("card_id").alias("ref_id"), c("retail").alias("price"))
    refs = names(T.fingerprints(spark, d).withColumnRenamed("row_id", "ref_id")).withColumn("ref_strip_0", c("strip")[0]).join(retail, "ref_id", "left")
    refs = settle(refs.select("ref_id", "name", "desc", "price", "ref_strip_0"))
    state = shared_path(spark, "live")
    writer = LV.live_reads(
        _stream(spark, live_frames(spark, d), "live-frames"), refs, state, T.FP_WORDS, T.FP_BITS, max_distance=GATE, min_name_margin=0, max_drift=64,
        flip_gate=38, hit={"margin": AMBIGUOUS, "band": BAND, "decisive": DECISIVE})
    writer.option("checkpointLocation", shared_path(spark, "live-check")).trigger(availableNow=True).start().awaitTermination()
    hits = SE.run_to_end(LV.live_hits(spark, state, near=1), shared_path(spark, "live-hits"))
    rows = LV.hits_with_rivals(hits, LV.stored_reads(spark, state, refs))
    return rows.select("device", "frame_no", "hit_id", "distance", "sharpest_frame", "orientation", "price", "confidence", "resolved", "ambiguous")


STATS = """SELECT user_id AS device, time_bucket(INTERVAL '6 hours', ts) AS window_start, count(*) AS frames, count(*) FILTER (event_type <> 'error') AS detected,
  count(*) FILTER (event_type <> 'error' AND value < 60) AS matched, count(*) FILTER (event_type <> 'error' AND value >= 60) AS refused,
  count(*) FILTER (event_type = 'view') / count(*) * 100 AS reused_pct, round(avg(value), 6) AS mean_ms, max(event_id % 8) AS max_vote_depth FROM events GROUP BY 1, 2"""


def _stats_input(spark, d):
    e = T.table(spark, d, "events").select("event_id", "event_type")
    return scan_log(spark, d).drop("reused").join(e, c("frame_no") == c("event_id")).select(
        "device", "ts", "detected", "accepted", (c("event_type") == "view").alias("reused"), c("best_distance").alias("total_ms"), (c("frame_no") % 8).alias("vote_depth"))


@query("g4_frame_stats", STATS)
def _(spark, d):
    return SE.frame_stats(_stats_input(spark, d), "6 hours").withColumn("mean_ms", F.round("mean_ms", 6))


@query("g4_frame_stats_stream", STATS.replace("SELECT", "SELECT", 1))
def _(spark, d):
    stream = SE.frame_stats(_stream(spark, _stats_input(spark, d), "stats", order="ts"), "6 hours")
    out = SE.run_to_end(stream, shared_path(spark, "stats-out"), "update")
    return SE.latest(out, ["device", "window_start"]).withColumn("mean_ms", F.round("mean_ms", 6))


_POINTS = """SELECT o_custkey AS collection_id, CAST(o_orderdate AS DATE) AS day, arg_max(o_totalprice, row(o_orderdate, o_totalprice, o_orderkey)) AS value,
  arg_max(o_orderkey, row(o_orderdate, o_totalprice, o_orderkey)) AS cards FROM orders GROUP BY 1, 2"""


@query("g5_daily_points_stream", _POINTS)
def _(spark, d):
    w = T.table(spark, d, "orders").select(
        c("o_custkey").alias("collection_id"), c("o_orderdate").cast("timestamp").alias("at"), c("o_totalprice").alias("value"), c("o_orderkey").alias("cards"))
    out = SE.run_to_end(SE.daily_points_stream(_stream(spark, w, "writes", "collection_id", "at")), shared_path(spark, "points"), "update")
    return SE.latest(out, ["collection_id", "day"])


def hits_log(spark, d):
    return T.table(spark, d, "events").select(
        c("user_id").alias("session"), "event_id", F.when(c("event_type") != "error", c("value")).alias("price"))


@query("g6_valuable_alerts", "SELECT user_id AS session, event_id, value AS price FROM events WHERE event_type <> 'error' AND value >= 100")
def _(spark, d):
    return SE.run_to_end(SE.valuable_alerts(_stream(spark, hits_log(spark, d), "alerts", "session", "event_id"), 100.0), shared_path(spark, "alerts-out"))


SESSIONS = """SELECT user_id AS session, count(*) AS hits, CAST(coalesce(sum(CAST(CASE WHEN event_type <> 'error' THEN value END AS DECIMAL(20,2))), 0) AS DOUBLE) AS total,
  count(*) FILTER (event_type <> 'error' AND value >= 100) AS flagged FROM events GROUP BY 1"""


@query("a11_session_totals", SESSIONS)
def _(spark, d):
    return SE.session_totals(hits_log(spark, d), 100.0)


@query("g7_session_totals_stream", SESSIONS)
def _(spark, d):
    out = SE.run_to_end(SE.session_totals(_stream(spark, hits_log(spark, d), "sessions", "session", "event_id"), 100.0), shared_path(spark, "sessions-out"), "update")
    return SE.latest(out, ["session"])


@query("l7_session_value", """WITH e AS (SELECT user_id AS session, event_id, CASE WHEN event_type IN ('click', 'view') THEN -1 ELSE 1 END AS n,
  coalesce(CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END, 0) AS cents FROM events),
f AS (SELECT session, list_reduce(list_prepend({'n': CAST(0 AS BIGINT), 'v': CAST(0 AS BIGINT)}, list({'n': CAST(n AS BIGINT), 'v': CAST(n * cents AS BIGINT)} ORDER BY event_id)),
  lambda a, b: {'n': greatest(0, a.n + b.n), 'v': greatest(0, a.v + b.v)}) AS s FROM e GROUP BY 1)
SELECT session, s.n AS hits, s.v / 100.0::DOUBLE AS value FROM f""")
def _(spark, d):
    undone = T.table(spark, d, "events").select("event_id", c("event_type").isin("click", "view").alias("undone"))
    rows = hits_log(spark, d).join(undone, "event_id").withColumnRenamed("event_id", "seq")
    out = SE.session_values(rows, F.floor(c("seq") / 2000))
    return out.groupBy("session").agg(F.max_by(F.struct("hits", "value"), "seq").alias("v")).select("session", "v.*")


# -- ledgers ------------------------------------------------------------------------
def ledger_log(spark, d, named=None):
    """Pile lines as a log: F orders add, O orders change, P orders undo or set. Further columns of ``named``, the cards' names, are kept."""
    lines = T.pile_lines(spark, d, ids=True)
    name = T.cards(spark, d).select("card_id", "name") if named is None else named
    # Days in order, and a day's lines by order and line number. A line's id is its own, not a hash of its values.
    event = F.concat_ws(":", "order_id", "line_no", "card_id", "seller")
    seq = F.unix_date(F.to_date("updated_at")).cast("bigint") * 2**40 + c("order_id") * 16 + c("line_no")
    # Lines of one number are of one order and line: only what follows tells them apart.
    tie = F.when(seq.isNull(), event).otherwise(F.concat_ws(":", "card_id", "seller"))
    op = F.when(c("origin") == "F", "add").when((c("origin") == "O") & (c("quantity") > 25), "reclassify").when(
        c("origin") == "O", "regrade").when(c("quantity") > 25, "set").otherwise("undo")
    return lines.join(name, "card_id").select(
        "collection_id", seq.alias("seq"), F.unix_millis("updated_at").alias("at"), c("updated_at").alias("ts"), event.alias("event_id"), tie.alias("tie"), op.alias("op"),
        "card_id", "name", "variant", "condition", "grader", "score", "quantity", "unit_price", "needs_printing",
        F.when(c("quantity") > 40, "Unlimited").alias("new_variant"), F.lit("MP").alias("new_condition"),
        F.when(c("grader").isNull(), "CGC").alias("new_grader"), F.when(c("grader").isNull(), 9.0).alias("new_score"),
        *[x for x in name.columns if x not in ("card_id", "name")],
    )


BY_SEQ = lambda: F.floor(F.col("seq") / 2**40 / 30)  # months


@query("l10_replay_log")
def _(spark, d):
    return LG.replay_log(ledger_log(spark, d), BY_SEQ())


def moving_log(spark, d):
    """The ledger's log with its largest lines as moves to the next collection and redirects to the next card of eight."""
    names = T.cards(spark, d).select("card_id", "name")
    right = names.groupBy(c("card_id").alias("next_id")).agg(F.collect_list(F.struct("name")).alias("next_names"))
    # The cards meet their neighbours, so that lines meet their cards once.
    named = names.withColumn("next_id", c("card_id") - c("card_id") % 8 + (c("card_id") + 1) % 8).join(right, "next_id", "left")
    log = ledger_log(spark, d, named)
    op = F.when((c("op").isin("reclassify", "add")) & (c("quantity") > 47), "move").when((c("op") == "set") & (c("quantity") > 46), "redirect").otherwise(c("op"))
    redirect = c("op") == "redirect"
    log = log.withColumn("op", op).withColumn("new_card_id", F.when(redirect, c("next_id")))
    log = log.withColumn("new_name", F.explode_outer(F.when(redirect, c("next_names")))).withColumn("new_name", c("new_name.name"))
    log = settle(LG.slim_log(LG.complete_log(log).select("collection_id", *LG.LOG_COLUMNS)))
    shelves = log.select("collection_id").distinct().agg(F.array_sort(F.collect_set("collection_id")).alias("all"), F.lit(1).alias("one"))  # a handful of segments
    log = log.withColumn("one", F.lit(1)).join(F.broadcast(shelves), "one").drop("one")
    at = F.array_position("all", c("collection_id")).cast("int")
    return log.withColumn("to_collection", F.element_at("all", F.pmod(at, F.size("all")) + 1)).drop("all")


@query("l10_replay_moves")
def _(spark, d):
    return LG.replay_log(moving_log(spark, d), BY_SEQ(), stored=True)


@query("g8_ledger_stream")
def _(spark, d):
    log = LG.slim_log(ledger_log(spark, d), keep=("name",)).drop("tie")  # a line's id is as good
    state = shared_path(spark, "ledger-state")
    stream = _stream(spark, log, "ledger-log", "event_id", "seq").withColumn("tie", c("event_id"))  # lines are told apart, collections are few
    writer = LG.ledger_stream(stream, state, BY_SEQ())
    writer.option("checkpointLocation", shared_path(spark, "ledger-check")).trigger(availableNow=True).start().awaitTermination()
    return LG.read_ledger(spark, state)


@query("l9_manage_collections")
def _(spark, d):
    e = T.table(spark, d, "events")
    op = F.when(c("event_type") == "signup", "add").when(c("event_type") == "view", "rename").when(c("event_type") == "click", "activate").otherwise("remove")
    return LG.manage_collections(e.select(
        c("user_id").alias("owner"), c("event_id").alias("seq"), op.alias("op"), (c("event_id") % 5).cast("string").alias("collection_id"),
        F.concat(F.lit("  box "), F.floor("value").cast("string")).alias("name"), F.unix_millis(c("ts").cast("timestamp")).alias("at")))


def allowance_events(spark, d):
    e = T.table(spark, d, "events")
    kind = F.when(c("event_type") == "click", "spend").when(c("event_type") == "view", "refund").when(c("event_type") == "signup", "ad").when(
        c("event_type") == "purchase", F.when(c("value") > 150, "pro_on").when(c("value") > 100, "pro_off").otherwise("pack")).otherwise("spend")
    pack = AL.pack_amount(F.when(c("value") < 5, "x.credits.200").otherwise("x.credits.none"))
    return e.select(
        "user_id", c("event_id").alias("seq"), c("ts").cast("timestamp").alias("at"), kind.alias("kind"), pack.cast("bigint").alias("amount"))


@query("g10_allowance_fold")
def _(spark, d):
    return AL.allowance_fold(allowance_events(spark, d), F.floor(c("seq") / 2000))


@query("g10_allowance_stream")
def _(spark, d):
    return SE.run_to_end(AL.allowance_stream(_stream(spark, allowance_events(spark, d), "quota", "user_id", "seq")), shared_path(spark, "quota-out"))


# Books by year of shipment, those of some years thinned out so that the gate refuses them.
# What an adopted book makes: the stored piles and wants it would reprice, and its manifest.
THIN, KEEP, LEAST = 3, 0.9, 20


@query("g9_price_refresh_stream", "WITH RECURSIVE " + T.PILES + ",\n" + T.PRICE_FEED + ",\n" + WANTS + f""",
books AS (SELECT year(l_shipdate) AS y, product_id AS card_id, variant, max(market) AS market FROM feed
  WHERE (market IS NOT NULL OR low IS NOT NULL) AND (year(l_shipdate) % {THIN} <> 0 OR product_id % 2 = 0) GROUP BY 1, 2, 3),
y AS (SELECT y, count(DISTINCT card_id) AS cards, row_number() OVER (ORDER BY y) AS rn FROM books GROUP BY 1),
r AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS y, CAST(0 AS BIGINT) AS cards, CAST(0 AS BIGINT) AS prev, CAST(NULL AS VARCHAR) AS reason
  UNION ALL
  SELECT s.rn, s.y, s.cards, CASE WHEN s.reason IS NULL THEN s.cards ELSE s.prev END, s.reason
  FROM (SELECT y.rn, y.y, y.cards, r.prev, CASE WHEN y.cards < {LEAST} THEN 'too few cards' WHEN r.prev > 0 AND y.cards < r.prev * {KEEP} THEN 'lost too many cards' END AS reason
        FROM r JOIN y ON y.rn = r.rn + 1) s),
p AS (SELECT y, count(*) AS piles FROM piles JOIN books USING (card_id, variant) WHERE market IS NOT NULL AND market IS DISTINCT FROM unit_price GROUP BY 1),
w AS (SELECT y, count(*) AS wants FROM wants JOIN (SELECT y, card_id, max(market) AS m FROM books GROUP BY 1, 2) USING (card_id) WHERE m IS NOT NULL AND m IS DISTINCT FROM unit_price GROUP BY 1)
SELECT r.y || '-12-31' AS as_of, CASE WHEN reason IS NULL THEN 'updated' ELSE 'refused' END AS status, reason,
  CASE WHEN reason IS NULL THEN r.cards END AS cards, CASE WHEN reason IS NULL THEN coalesce(piles, 0) END AS piles, CASE WHEN reason IS NULL THEN coalesce(wants, 0) END AS wants
FROM r LEFT JOIN p USING (y) LEFT JOIN w USING (y) WHERE r.rn > 0""")
def _(spark, d):
    feed = T.price_feed(spark, d, keep=["l_shipdate"]).withColumn("y", F.year("l_shipdate"))
    feed = feed.filter((c("market").isNotNull() | c("low").isNotNull()) & ((c("y") % THIN != 0) | (c("product_id") % 2 == 0)))
    books = feed.groupBy("y", c("product_id").alias("card_id"), "variant").agg(
        F.max("market").alias("market"), F.max("low").alias("low"), F.max("high").alias("high")).select(
        "card_id", "variant", "market", "low", "high", F.concat(c("y").cast("string"), F.lit("-12-31")).alias("as_of"),
        F.to_timestamp(F.concat(c("y").cast("string"), F.lit("-12-31 08:00:00"))).alias("checked_at"))
    # The lines are joined once for both; what every book meets is stored narrow and dealt by the keys of its join.
    lines = settle(T.pile_lines(spark, d).drop("key"))
    piles = settle_by(T.piles(spark, d, lines).select("card_id", "variant", "unit_price"), "card_id", "variant")
    wanted = settle_by(wants(spark, d, lines).select("card_id", "unit_price"), "card_id")

    def adopted(book, path):
        count = lambda rows, name: rows.agg(F.sum(c("changed").cast("bigint")).alias(name)).withColumn("one", F.lit(1))
        changed = count(L.reprice_piles(piles, book), "piles").join(count(L.reprice_wants(wanted, book), "wants"), "one")
        manifest(book).withColumn("one", F.lit(1)).join(changed, "one").drop("one").write.mode("overwrite").parquet(path)

    state, check = shared_path(spark, "book-state"), shared_path(spark, "book-check")
    for arrived in SE.arrivals(books, shared_path(spark, "books"), "checked_at"):
        writer = RF.price_refresh_stream(arrived, state, min_cards=LEAST, keep=KEEP, on_adopt=adopted)
        writer.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    made = spark.read.schema("updated string, cards bigint, piles bigint, wants bigint").parquet(f"{state}/made/*")
    done = RF.verdicts(spark, state).select("as_of", "status", "reason")
    return done.join(made, (c("as_of") == c("updated")) & (c("status") == "updated"), "left").drop("updated")
