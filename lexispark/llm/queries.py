"""The operators applied to their whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm import bpe, chat, dedup, fim, jaccard, langid, media, packing, quality, sharding, simhash, toxicity, whitening
from lexispark.llm.common import prepare, remainder, saved, table


#: Bytes of a shard of sharding_small.
SMALL_LIMIT = 100_000


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fitted(docs, held_out=(3, 1)))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def sharding_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_sharding at a limit that splits small tables too."""
    return sharding.shards(table(spark, sf_dir, "documents"), SMALL_LIMIT)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.DEFAULT_VOCABULARY), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels"), held_out=(3, 1)), held_out=(3, 1))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.DEFAULT_VOCABULARY), public_tokenizers.PATTERN)


def examples(conversations: DataFrame) -> DataFrame:
    """(doc_id, text, response): an answer with the turn before it, unless that is an answer too, and other turns without a response; every turn once."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    # a turn's name; nulls and turns that share one are told apart by their places
    alike = F.count("*").over(Window.partitionBy("conv_id", "turn")) > 1
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit("-")))
    name = F.when(alike | F.col("conv_id").isNull() | F.col("turn").isNull(), F.concat(name, F.lit("#"), F.row_number().over(w))).otherwise(name)
    turns = conversations.select(name.alias("doc_id"), answer.alias("answer"), "text", F.lag("text").over(w).alias("before"), F.lag(answer).over(w).alias("after_answer"), F.lead(answer).over(w).alias("answered"))
    own = F.when(F.col("answer"), F.when(~F.coalesce("after_answer", F.lit(True)), F.col("before"))).otherwise(F.col("text"))
    some = turns.where("answer OR NOT coalesce(answered, false)")
    return some.select("doc_id", own.alias("text"), F.when(F.col("answer"), F.coalesce("text", F.lit(""))).alias("response"))


def packing_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_packing for answers and the turns before them, and the turns that no answer follows, under three limits that differ."""
    limits = packing.Limits(tokens=1024, segments=8, loss_tokens=640)
    return packing.pack(examples(table(spark, sf_dir, "conversations")), public_tokenizers.path(packing.DEFAULT_VOCABULARY), public_tokenizers.PATTERN, limits=limits, response_col="response")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_likeness(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height", "bit_depth")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    nodes = saved(chat.chain(rows.unionByName(more)), "chat-nodes")
    strings = saved(chat.formatted(nodes), "chat-strings")
    return chat.digests(strings).withColumnRenamed("tree", "conv_id")


def chat_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best branches of each conversation read as a tree: every third turn answers what the turn before it answered.

    A branch's score is the mean length of its turns.
    """
    nodes = chat.chain(table(spark, sf_dir, "conversations"))
    again = (F.col("node") % 3 == 0) & (F.col("node") > 2)
    nodes = nodes.withColumn("parent", F.when(again, F.col("node") - 2).otherwise(F.col("parent"))).withColumn("score", F.length("text").cast("double"))
    best = chat.branches(saved(nodes, "chat-nodes"), 2)
    chars = F.aggregate("turns", F.lit(0), lambda n, t: n + F.length(t["text"]))
    return best.select("tree", "leaf", "rank", F.round("branch_score", 6).alias("branch_score"), F.size("turns").alias("n_turns"), chars.alias("n_chars"), F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"))


_BRANCHES = """
WITH RECURSIVE turns AS (
  SELECT conv_id AS tree, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS node, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), nodes AS (
  SELECT *, CASE WHEN node % 3 = 0 THEN node - 2 WHEN node > 1 THEN node - 1 END AS parent FROM turns
), steps AS (
  SELECT tree, node AS leaf, node, parent, 0 AS up FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.tree IS NOT DISTINCT FROM n.tree AND c.parent = n.node)
  UNION ALL
  SELECT s.tree, s.leaf, n.node, n.parent, s.up + 1 FROM steps s JOIN nodes n ON n.tree IS NOT DISTINCT FROM s.tree AND n.node = s.parent
), found AS (
  SELECT s.tree, s.leaf, avg(length(n.text)) AS score, count(*) AS n_turns, sum(length(n.text)) AS n_chars, string_agg(n.role, ',' ORDER BY s.up DESC) AS roles
  FROM steps s JOIN nodes n ON n.tree IS NOT DISTINCT FROM s.tree AND n.node = s.node GROUP BY s.tree, s.leaf
)
SELECT tree, leaf, CAST(row_number() OVER (PARTITION BY tree ORDER BY score DESC, leaf) AS INTEGER) AS rank, round(score, 6) AS branch_score, CAST(n_turns AS INTEGER) AS n_turns, CAST(n_chars AS INTEGER) AS n_chars, roles
FROM found QUALIFY row_number() OVER (PARTITION BY tree ORDER BY score DESC, leaf) <= 2
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fitted(docs, table(spark, sf_dir, "labels"), held_out=(4, 2)), held_out=(4, 2))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_sharding, op3_jaccard, op4_bpe, op5_toxicity, op6_packing, op7_simhash, op8_media, op9_chat, op10_quality, op11_fim, op12_whitening, op13_dedup, sharding_small, packing_instructions, chat_branches)}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sharding.oracle(), "sharding_small": sharding.oracle(SMALL_LIMIT), "op11_fim": fim.ORACLE, "op13_dedup": dedup.ORACLE, "chat_branches": _BRANCHES}
