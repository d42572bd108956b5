"""Term-frequency vectors as postings, inverse document frequencies, and the sparse candidate leg."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import tokens
from lexispark.operators.grid import sparse_join
from lexispark.operators.ranking import Best, top_k
from lexispark.package import ship
from lexispark.storage import saved


def stop_words(language: str = "russian") -> list[str]:
    return StopWordsRemover.loadDefaultStopWords(language)


def counted(df: DataFrame, tokens_col: str = "ts", out: str = "terms") -> DataFrame:
    """df with (out array<struct<token, tf>>) in place of its arrays of tokens: a batch's tokens are numbered and counted at once, and nothing is shuffled."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != tokens_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keep))
            flat = lists.flatten().dictionary_encode()
            words = max(1, len(flat.dictionary))
            code, tf = np.unique(pc.list_parent_indices(lists).to_numpy().astype(np.int64) * words + flat.indices.to_numpy(), return_counts=True)
            ends = np.cumsum(np.bincount(code // words, minlength=b.num_rows))
            pairs = pa.StructArray.from_arrays([flat.dictionary.take(pa.array(code % words)), pa.array(tf.astype(np.float64))], names=["token", "tf"])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pairs)], names=[*keep, out])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.coalesce(tokens_col, F.array().cast("array<string>")).alias(tokens_col)).mapInArrow(run, f"{kinds}, `{out}` array<struct<token:string,tf:double>>")


def terms(df: DataFrame, id_col: str, text_col: str, stops: Sequence[str] = (), min_length: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """(id, *keep, terms array<struct<token, tf>>) of every row, row by row: nothing is shuffled."""
    return counted(df.select(id_col, *keep, tokens(F.col(text_col), stops, min_length).alias("ts")))


def postings(df: DataFrame, id_col: str, text_col: str, stops: Sequence[str] = (), min_length: int = 2, unique: bool = False) -> DataFrame:
    """(id, token, tf): a text without tokens has no rows. Keyed by the token, so no vocabulary has to be agreed on.

    unique: no id has two rows; then a text's tokens are counted within its row and nothing is shuffled. Otherwise the
    counts of an id's rows are added up.
    """
    each = terms(df, id_col, text_col, stops, min_length).select(id_col, F.inline("terms"))
    return each if unique else each.groupBy(id_col, "token").agg(F.sum("tf").alias("tf"))


def vocabulary(post: DataFrame) -> DataFrame:
    """(token, df): how many points have the token."""
    return post.groupBy("token").agg(F.count("*").alias("df"))


def token_ids(post: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(token, token_id) of all tokens; known ones keep their ids, new ones follow the largest.

    Ids are made by range partitions with a running offset, so that no task sees all tokens.
    """
    spark = post.sparkSession
    fresh = post.select("token").distinct()
    start = 0
    if known is not None:
        last = known.agg(F.max("token_id")).first()[0]
        start = 0 if last is None else last + 1
        fresh = fresh.join(known, "token", "left_anti")
    placed = fresh.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(4096)))
    sizes = placed.groupBy("bucket").count().orderBy("bucket").collect()  # 4096 rows at most
    offsets, at = [], start
    for r in sizes:
        offsets.append((int(r["bucket"]), at))
        at += r["count"]
    base = spark.createDataFrame(offsets, "bucket bigint, base bigint")
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("token")) - 1
    out = placed.join(F.broadcast(base), "bucket").withColumn("number", number).select("token", (F.col("base") + F.col("number")).alias("token_id"))
    return out if known is None else known.select("token", "token_id").unionByName(out)


def first_seen_ids(df: DataFrame, order_col: str, tokens_col: str = "ts", known: DataFrame | None = None, rows: int = 1 << 20) -> DataFrame:
    """(token, token_id): ids in the order in which tokens first occur, by order_col and then by place in the row's array.

    Known ids stay, new tokens follow the largest. Each token's first place is a partial minimum; these are dealt into ranges of about `rows` of them,
    numbered within their ranges, and moved on by the sizes of the ranges before, so that no task sees all tokens. Rows that share an order value count as
    one row whose tokens stand side by side; ties between such rows go to the smaller token; null tokens have no id.
    """
    spark = df.sparkSession
    each = df.select(F.col(order_col).alias("o"), F.posexplode(tokens_col).alias("at", "token")).where("token is not null")
    first = each.groupBy("token").agg(F.min(F.struct("o", "at")).alias("m")).select("token", "m.*")
    start = 0
    if known is not None:
        last = known.agg(F.max("token_id")).first()[0]
        start = 0 if last is None else last + 1
        first = first.join(known.select("token"), "token", "left_anti")
    first = saved(first, "first-seen")
    ranges = max(1, -(-first.count() // rows))
    order = ("o", "at", "token")
    # the number of a row within its task, and which task that is
    place = F.monotonically_increasing_id()
    placed = saved(first.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("token", F.shiftright(place, 33).alias("range"), place.bitwiseAND((1 << 33) - 1).alias("place")), "placed")
    offsets, at = [], start
    for r in placed.groupBy("range").count().orderBy("range").collect():  # a row for each range
        offsets.append((r["range"], at))
        at += r["count"]
    base = spark.createDataFrame(offsets, "range bigint, base bigint")
    out = placed.join(F.broadcast(base), "range").select("token", (F.col("base") + F.col("place")).alias("token_id"))
    return out if known is None else known.select("token", "token_id").unionByName(out)


def with_idf(freq: DataFrame, n: int) -> DataFrame:
    """(token, df, idf): ln((N - df + 0.5) / (df + 0.5) + 1), never negative."""
    return freq.withColumn("idf", F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


#: Numbers of query weights (tokens x queries) that a pass over the points carries along; more queries meet the points on a grid.
PASS_WEIGHTS = 8 << 20
#: Rows of the queries' tokens that the driver gathers; likewise.
PASS_ROWS = 1 << 20
#: Rows of the lists of k points that a task keeps for the queries of a pass; likewise.
PASS_KEPT = 1 << 20
#: Products (tokens of points x queries) that are held at a time.
HELD = 4 << 20


def sparse_leg(query_post: DataFrame, point_tokens: DataFrame, n: int, k: int, kept: DataFrame | None = None, query_col: str = "query_id", point_col: str = "point_id", pass_weights: int = PASS_WEIGHTS, frequencies: DataFrame | None = None) -> DataFrame:
    """(query, point, score, rank): tf-idf products over shared tokens. Points that share none are no candidates.

    query_post: query, token, tf. point_tokens: point, ts (its tokens, with repeats), or point, terms. n: points in all.
    kept: the points that may be found (all where None); frequencies are of all points: (token, df), counted where None.

    The stated queries' tokens are gathered by the driver and go along with the points, within pass_weights and PASS_ROWS; more queries meet
    the points on a grid (grid.sparse_join()). One pass keeps what each point has of these tokens, as numbers in a saved table;
    unless they are given their frequencies come from that table, and a second pass over it multiplies a batch's counts by the queries' weights and lets a
    task's best k of each query leave it. A token that every point has is a row of weights like any other: no key is
    shuffled, and no point meets a query twice.
    """
    spark = point_tokens.sparkSession
    ship(spark)
    asked = query_post.select(F.col(query_col).alias("q"), "token", F.col("tf").cast("double").alias("tf")).where("tf > 0")
    q_kind, p_kind = asked.schema["q"].dataType.simpleString(), point_tokens.schema[point_col].dataType.simpleString()
    ddl = f"`{query_col}` {q_kind}, `{point_col}` {p_kind}, score double"
    most = min(pass_weights, PASS_ROWS)
    got = asked.limit(most + 1).toArrow().combine_chunks()
    if not got.num_rows:
        return top_k(spark.createDataFrame([], ddl), k, query_col, point_col)
    words, q_ids = pc.unique(got.column("token")), pc.unique(got.column("q"))
    as_terms = "terms" in point_tokens.columns
    if got.num_rows > most or len(words) * len(q_ids) > pass_weights or len(q_ids) * k > PASS_KEPT:
        whole = point_tokens if as_terms else counted(point_tokens.select(point_col, "ts"))
        if frequencies is None:  # counted, sized and joined: texts are tokenised once
            whole = saved(whole, "terms")
        known = frequencies if frequencies is not None else vocabulary(whole.select(F.inline("terms")))
        return sparse_join(query_post, whole, known, n, k, kept, query_col, point_col)
    row = pc.index_in(got.column("token"), value_set=words).to_numpy()
    of = pc.index_in(got.column("q"), value_set=q_ids).to_numpy()
    lists = (F.col("terms.token").alias("ts"), F.col("terms.tf").alias("tf")) if as_terms else ("ts",)
    found = point_tokens.select(F.col(point_col).alias("p"), *lists).mapInArrow(_numbered(spark.sparkContext.broadcast(words), as_terms), f"p {p_kind}, at array<int>, tf array<double>")
    df = np.zeros(len(words))
    if frequencies is None:
        found = saved(found, "matching")
        for r in found.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect():  # a row for each of the queries' tokens
            df[r["at"]] = r["df"]
    else:
        known = asked.select("token").distinct().join(frequencies.select("token", "df"), "token").toArrow()  # likewise
        df[pc.index_in(known.column("token"), value_set=words).to_numpy()] = known.column("df").to_numpy()
    if kept is not None:  # of points, only what they have of the queries' tokens is shuffled
        found = found.join(kept.select(F.col(point_col).alias("p")), "p", "left_semi")
    weight = got.column("tf").to_numpy() * np.log((n - df + 0.5) / (df + 0.5) + 1)[row]
    shared = spark.sparkContext.broadcast((q_ids, row, of, weight, len(words)))
    return top_k(found.mapInArrow(_scored(shared, k, query_col, point_col), ddl), k, query_col, point_col)


def _numbered(shared, as_terms: bool):
    """Points with the numbers of their tokens among the queries', each once, and how often they have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            lists = b.column(1)
            at = pc.index_in(lists.flatten(), value_set=words)
            owner = pc.list_parent_indices(lists).to_numpy()
            known = pc.is_valid(at).to_numpy(zero_copy_only=False)
            code = owner[known] * len(words) + at.drop_null().to_numpy()
            # a point's tokens, each once
            code, inverse = np.unique(code, return_inverse=True)
            tf = np.bincount(inverse, b.column(2).flatten().to_numpy()[known] if as_terms else None, len(code)).astype(np.float64)
            ids, sizes = np.unique(code // len(words), return_counts=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            numbers = pa.ListArray.from_arrays(offsets, pa.array(code % len(words), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids)), numbers, pa.ListArray.from_arrays(offsets, pa.array(tf))], names=["p", "at", "tf"])

    return run


def _scored(shared, k: int, query_col: str, point_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, row, of, weight, n_words = shared.value
        table = np.zeros((n_words, len(asked)))
        table[row, of] = weight
        best = Best(asked, k, float(np.nextafter(0, 1)))  # a score above zero shares a token
        for b in batches:
            if not b.num_rows:
                continue
            sizes = pc.list_value_length(b.column(1)).to_numpy()
            starts = np.cumsum(sizes) - sizes
            at, tf = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            s = np.empty((len(asked), b.num_rows))
            step = max(1, HELD // max(len(at), 1))
            for i in range(0, len(asked), step):
                s[i : i + step] = np.add.reduceat(table[at, i : i + step] * tf[:, None], starts, axis=0).T
            best.add(s, b.column(0))
        yield from best.batches([query_col, point_col, "score"])

    return run
