"""One query per operator, over the whole of its table; oracles where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.bindings.reg import registrar
from vitrine.llm import decontaminate, hilbert, langid, neighbours, packing, pseudonyms, quality, septokens, simhash, spelling, toxicity, urlcascade, whitening
from vitrine.llm.common import id_bucket, table

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


@query("op1_simhash_near_duplicates")
def op1_simhash_near_duplicates(spark, sf_dir):
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_hilbert_shards")
def op4_hilbert_shards(spark, sf_dir):
    return hilbert.places(table(spark, sf_dir, "documents"), "rows")


URL_RULES = "VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')"


@query("op9_url_cascade", sql=f"""
WITH rules(verdict, host, path) AS ({URL_RULES}),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
fit AS (
  SELECT n.page_id, max({{'n': length(r.host || r.path), 'verdict': r.verdict, 'rule': r.host || r.path}}) AS best
  FROM named n JOIN rules r ON (n.host = r.host OR n.host LIKE '%.' || r.host) AND starts_with(n.path, r.path)
  GROUP BY 1)
SELECT n.page_id, n.host, n.path, f.best.rule AS rule, coalesce(f.best.verdict, 'allow') AS verdict
FROM named n LEFT JOIN fit f USING (page_id)""")
def op9_url_cascade(spark, sf_dir):
    rules = spark.sql(f"SELECT * FROM {URL_RULES} AS r(verdict, host, path)")
    return urlcascade.judge(table(spark, sf_dir, "pages"), rules)


@query("op8_reduced_packing")
def op8_reduced_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op6_separator_scan")
def op6_separator_scan(spark, sf_dir):
    return septokens.count_documents(table(spark, sf_dir, "documents"))


@query("op7_string_kernel_language")
def op7_string_kernel_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


@query("op2_convolutional_toxicity")
def op2_convolutional_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_template_decontamination")
def op5_template_decontamination(spark, sf_dir):
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "verbatim", "windows", "matched")


@query("op10_feistel_pseudonyms")
def op10_feistel_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs).withColumnRenamed("_replaced", "replaced")


@query("op3_learned_partitions")
def op3_learned_partitions(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op11_feast_whitening")
def op11_feast_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.runs(table(spark, sf_dir, "documents")))


@query("op13_pairwise_quality")
def op13_pairwise_quality(spark, sf_dir):
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
