"""The registered queries op1..op13: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.llm import bpe, chat, decontaminate, embedding_dedup, filter_audit, langid, periodic, pii, quality, sharding, simhash, substring, toxicity
from mosaica.llm.common import table

TOKENIZER = "byte_bpe_50k.tiktoken"


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.duplicate_passages(table(spark, sf_dir, "documents"))


def held_out() -> F.Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    profiles = langid.learn(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), profiles)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality_score", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    labels = table(spark, sf_dir, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.learn(docs.where("not held_out").join(labels, "doc_id"))
    return model.score(docs.select("doc_id", "held_out", "text")).select("doc_id", "held_out", "score", "predicted")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    return chat.read_back(*chat.prefix_tree(rows.unionByName(more)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = sharding.shard(docs, "text", "size", ["doc_id", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def repeated(words: np.ndarray, g: int) -> np.ndarray:
    """words (some) whose tail, from place g % n on, repeats its first words; how many, g says."""
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = words.copy()
    out[a:] = words[a + np.arange(n - a) % p]
    return out


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document whose id's CRC ends in 0 gets a repeating tail first."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periodic.digests(table(spark, sf_dir, "documents"), change=F.when(h % 10 == 0, F.floor(h / 10)), changed=repeated)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


#: The audit over the masks of all documents: five conditions, 120 orders as rows, and for each order the step that removes each mask.
AUDIT_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
 l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
 m AS (SELECT part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
     || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
     || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM w LEFT JOIN l USING (doc_id)),
 c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY ALL),
 f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
 o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
 s AS (SELECT filter_order, CAST(i AS INT) AS step, substr(filter_order, CAST(i AS INT), 1) AS f FROM o CROSS JOIN range(1, 6) r(i)),
 g AS (SELECT fails, filter_order, min(step) AS gone FROM (SELECT DISTINCT fails FROM c) JOIN s ON contains(fails, f) GROUP BY ALL),
 x AS (SELECT c.part, s.filter_order, s.step, s.f,
     sum(CASE WHEN g.gone IS NULL OR g.gone > s.step THEN n ELSE 0 END) AS kept, sum(CASE WHEN g.gone = s.step THEN n ELSE 0 END) AS removed, sum(CASE WHEN g.gone < s.step AND contains(c.fails, s.f) THEN n ELSE 0 END) AS redundant,
     sum(CASE WHEN c.fails = s.f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN g.gone = s.step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN g.gone = s.step THEN bad ELSE 0 END) AS toxic_lost
   FROM c CROSS JOIN s LEFT JOIN g ON g.fails = c.fails AND g.filter_order = s.filter_order GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM x"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": AUDIT_SQL}
