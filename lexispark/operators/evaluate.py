"""Recall, MRR and nDCG of ranked hits against relevant ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def per_query(hits: DataFrame, qrels: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """(query_id, k, recall, mrr, ndcg), rounded to 6. hits: query_id, item_id, rank; qrels: query_id, relevant_id.

    Queries without hits score 0. The ideal gain counts repeated relevant ids, recall does not. k = 0 means no bound for
    MRR, and 0 for the others.
    """
    want = qrels.groupBy("query_id").agg(F.countDistinct("relevant_id").alias("n_rel"), F.count("relevant_id").alias("n_list"))
    good = hits.join(qrels.where("relevant_id is not null").distinct().select("query_id", F.col("relevant_id").alias("item_id")), ["query_id", "item_id"]).groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    return _metrics(want, good, ks)


def per_query_of_labels(hits: DataFrame, asked: DataFrame, items: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """per_query() where the relevant items of a query are the others of its label. asked: query_id, label; items: item_id, label.

    A label's items are counted, not listed for each query, so the work grows with hits and items, not with their pairs. Query ids
    are unique; null ids and labels are relevant to nothing, and queries without relevant items are left out.
    """
    # how often an item has a label, and how many items and rows a label has
    known = items.where("item_id is not null and label is not null").groupBy("item_id", "label").agg(F.count("*").alias("own"))
    sizes = known.groupBy("label").agg(F.count("*").alias("n_items"), F.sum("own").alias("n_rows"))
    mine = known.select(F.col("item_id").alias("query_id"), "label", "own")
    want = asked.join(sizes, "label").join(mine, ["query_id", "label"], "left")
    want = want.select("query_id", (F.col("n_items") - F.col("own").isNotNull().cast("bigint")).alias("n_rel"), (F.col("n_rows") - F.coalesce("own", F.lit(0))).alias("n_list")).where("n_list > 0")
    pairs = hits.where("query_id <> item_id").join(asked, "query_id").join(known.select("item_id", "label"), ["item_id", "label"])
    good = pairs.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    return _metrics(want, good, ks)


def _metrics(want: DataFrame, good: DataFrame, ks: Sequence[int]) -> DataFrame:
    """want: query_id, n_rel, n_list; good: query_id, item_id, rank of the relevant hits."""
    grid = want.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    joined = grid.join(good.select("query_id", "rank"), "query_id", "left")
    inside = F.col("rank") <= F.col("k")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_list"), F.col("k").cast("bigint")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    ideal = F.when((F.col("k") > 0) & (F.col("n_list") > 0), ideal).otherwise(0.0)
    got = joined.groupBy("query_id", "k", "n_rel", "n_list").agg(
        F.sum(F.when(inside, 1.0).otherwise(0.0)).alias("found"),
        F.min(F.when(inside | (F.col("k") == 0), F.col("rank"))).alias("first"),
        F.sum(F.when(inside, 1 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)).alias("dcg"),
    )
    return got.select(
        "query_id",
        "k",
        F.round(F.when(F.col("n_rel") > 0, F.col("found") / F.col("n_rel")).otherwise(0.0), 6).alias("recall"),
        F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """(metric, k, mean, std, low, high): the population's deviation."""
    long = metrics.select("k", F.explode(F.map_from_arrays(F.array(F.lit("recall"), F.lit("mrr"), F.lit("ndcg")), F.array("recall", "mrr", "ndcg"))).alias("metric", "value"))
    r = lambda c: F.round(c, 6)
    return long.groupBy("metric", "k").agg(r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("std"), r(F.min("value")).alias("low"), r(F.max("value")).alias("high"))


def log_run(summary_rows: DataFrame, path: str, run_id: str, parameters: dict[str, str] | None = None) -> None:
    """Append a run's summary and its parameters to a metrics table."""
    pairs = [F.lit(x) for kv in sorted((parameters or {}).items()) for x in map(str, kv)]
    kept = (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")
    summary_rows.withColumn("run_id", F.lit(run_id)).withColumn("parameters", kept).write.mode("append").parquet(path)
