"""Queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import functions as F

from notecover.llm import (decontam, embeddings, fim, katz, linededup, minhash, packing, secretscan, sharding, tokenalign, toxicity,
                           urlfilter, warc)
from notecover.llm.common import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_minhash")
def op10(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinHash(shingle_words=2))


@query("op7_rotation_codes")
def op7(spark, sf_dir):
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query("op8_pattern_packing")
def op8(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op2_url_filter")
def op2(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


@query("op5_spaced_seeds")
def op5(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_sampled_splitters")
def op9(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op4_secret_scan")
def op4(spark, sf_dir):
    """Findings without their values: a checksum stands for them."""
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "k", "start", F.length("value").alias("length"), F.crc32("value").alias("value_crc32"),
                        "score", F.col("is_secret").cast("int").alias("is_secret"))


@query("op6_warc_derivatives")
def op6(spark, sf_dir):
    """Records by their digests; the blocks themselves stay with the operator."""
    r = warc.derive(table(spark, sf_dir, "pages"))
    return r.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length",
                    "block_digest", "payload_digest", F.sha1(F.col("headers").cast("binary")).alias("headers_sha1"))


@query("op3_katz_backoff")
def op3(spark, sf_dir):
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    return katz.scores(table(spark, sf_dir, "documents"), held_out)


OP11_SQL = r"""
WITH ls AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM ls),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(f.first < k.doc_id, FALSE) AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@query("op11_line_dedup", OP11_SQL)
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = linededup.dedup(linededup.build(docs), docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op12_token_alignment")
def op12(spark, sf_dir):
    aligned = tokenalign.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    counted = tokenalign.with_counts(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (
  SELECT *, string_split(t, chr(10)) AS l,
    length(t) - length(replace(t, chr(10), '')) + CAST(t <> '' AND right(t, 1) <> chr(10) AS BIGINT) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y FROM u),
p AS (
  SELECT *, CASE WHEN x = 0 THEN 0 WHEN x = n THEN length(t) ELSE length(array_to_string(l[1 : x], chr(10))) + 1 END AS a,
    CASE WHEN y = 0 THEN 0 WHEN y = n THEN length(t) ELSE length(array_to_string(l[1 : y], chr(10))) + 1 END AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
s AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM s"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark, sf_dir):
    out = fim.transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(fim.restored("output", "form").cast("binary"), 256).alias("restored_sha256"))
