"""Questions that a model writes for articles without one, kept in a table so that a run goes on where the last one stopped.

A prompt is known by its SHA-256: articles with equal prompts ask once. Results are appended to a Parquet table bucket by bucket,
so what a failed run had finished stays. A prompt that failed is open to later runs until it has had `attempts` of them.

Defined results: articles with a question keep it; a null or empty answer counts as a failure, as an error of the model does; null texts make prompts
as empty ones do; of several answers to one prompt, as two runs at a time would leave, the smallest counts; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import truncate
from lexispark.package import ship
from lexispark.storage import forget, saved

_STORED = "key string, query_text string, error string, run bigint"


def prompts(articles: DataFrame, template: str, most: int = 8000) -> DataFrame:
    """articles with prompt and key, both null where there is a question; {text} in template is the text cut to `most` characters."""
    before, _, after = template.partition("{text}")
    prompt = F.concat(F.lit(before), truncate(F.coalesce("article_text", F.lit("")), most), F.lit(after))
    made = articles.withColumn("prompt", F.when(F.col("query_text").isNull(), prompt))
    return made.withColumn("key", F.sha2("prompt", 256))


def stored(articles: DataFrame, folder: str) -> DataFrame:
    """(key, query_text, error, run): every attempt so far."""
    spark = articles.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(_STORED).parquet(folder) if there else spark.createDataFrame([], _STORED)


def open_prompts(articles: DataFrame, folder: str, template: str, attempts: int = 3, most: int = 8000) -> DataFrame:
    """(key, prompt) without an answer and with attempts left, each once."""
    asked = prompts(articles, template, most).where("key is not null").groupBy("key").agg(F.min("prompt").alias("prompt"))
    tried = stored(articles, folder).groupBy("key").agg(F.count("*").alias("n"), F.count("query_text").alias("answers"))
    return asked.join(tried, "key", "left").where(F.col("n").isNull() | ((F.col("answers") == 0) & (F.col("n") < attempts))).select("key", "prompt")


def ask(articles: DataFrame, folder: str, llm: Callable[[str], str], template: str, attempts: int = 3, buckets: int = 8, most: int = 8000) -> int:
    """One attempt at every open prompt; how many attempts there were. Each bucket's results are safe once it is written."""
    ship(articles.sparkSession)
    run = (stored(articles, folder).agg(F.max("run")).first()[0] or 0) + 1
    # written once, as the table that it is joined with grows meanwhile
    waiting = saved(open_prompts(articles, folder, template, attempts, most).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))), "open-prompts")

    def answered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, prompt in zip(part["key"], part["prompt"]):
                try:
                    answer = llm(prompt)
                    rows.append((key, answer or None, None if answer else "no answer", run))
                except Exception as e:  # any error of a foreign model is that prompt's own
                    rows.append((key, None, f"{type(e).__name__}: {e}", run))
            yield pd.DataFrame(rows, columns=["key", "query_text", "error", "run"])

    total = 0
    for r in waiting.groupBy("bucket").count().orderBy("bucket").collect():  # a row for each bucket
        waiting.where(F.col("bucket") == r["bucket"]).select("key", "prompt").mapInPandas(answered, _STORED).write.mode("append").parquet(folder)
        total += r["count"]
    forget(waiting)
    return total


def filled(articles: DataFrame, folder: str, template: str, most: int = 8000) -> DataFrame:
    """articles with the stored answers as query_text; those without any stay null."""
    answers = stored(articles, folder).where("query_text is not null").groupBy("key").agg(F.min("query_text").alias("answer"))
    asked = prompts(articles, template, most).drop("prompt").join(answers, "key", "left")
    return asked.withColumn("query_text", F.coalesce("query_text", "answer")).select(*articles.columns)
