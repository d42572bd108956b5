"""A collection: tables of points and their terms below one folder, in numbered versions that share what they do not change.

A version names its base, a folder for each of its parts by a hash of article_id, and its deltas. An update writes a
delta: its own points and their terms, the lists of articles and points that it takes away, and by how much it changes each
token's document frequency. Readers merge: a row lives unless a later delta takes its article or its point away. Compaction
folds the deltas into new folders of the parts that they touch and takes the other parts over. The number of points and the document frequencies
are kept with the versions, so a search counts nothing.

Chunks, as chunking.chunk() makes them, do not carry their article's text: it is stored once, with the article's first chunk, and
joined with what a search has found.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lexispark.operators.filters import compiled, named
from lexispark.operators.sparse import terms, vocabulary
from lexispark.storage import forget, saved, sweep


def upsert(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """old with new rows in place of those with an equal key; of repeated new keys the one of the largest batch stays.

    Rows of one key and batch are ordered by a hash of the row, so that a run repeated gives the same row.
    """
    batch = F.coalesce(F.col("batch"), F.lit(0)).cast("bigint") if "batch" in new.columns else F.lit(0).cast("bigint")
    both = old.withColumn("batch", F.lit(-1).cast("bigint")).unionByName(new.withColumn("batch", batch), allowMissingColumns=True)
    latest = Window.partitionBy(key).orderBy(F.desc("batch"), F.xxhash64(*both.columns))
    return both.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "batch")


#: Rows of a version's list that are no parts: its schema, its deltas, the texts' schema, and the versions whose changes of frequencies add up to its own.
_SCHEMAS, _DELTA, _CHANGES, _TEXTS = -1, -2, -3, -4
_LIST = "part int, version int, schema string, n bigint"
_FREQUENCIES = StructType([StructField("token", StringType()), StructField("df", LongType())])
_TERMS = ArrayType(StructType([StructField("token", StringType()), StructField("tf", DoubleType())]))
#: Rows of the lists of what deltas take away that go along with the points (about 64 MB); longer lists are joined by a shuffle.
ALONG = 1 << 21
#: The lists of a delta: key -> table.
_GONE = {"article_id": "gone_articles", "point_id": "gone_points"}
_TABLES = ("delta_points", "delta_terms", "delta_texts", "changes", *_GONE.values())


def _of_terms(points: StructType) -> StructType:
    """The terms' columns for such points."""
    return StructType([*(points[c] for c in ("point_id", "article_id") if c in points.names), StructField("terms", _TERMS)])


def _split(points: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Chunks without their articles' texts, and (article_id, article_text) of each article; other points stay as they are."""
    if not {"article_id", "article_text", "parent_no", "pos"} <= set(points.columns):
        return points, None
    first = points.where("parent_no = 0 AND pos = 0 AND article_id IS NOT NULL")
    return points.drop("article_text"), first.select("article_id", "article_text")


@dataclass
class Collection:
    """Points and terms in `parts` parts; a version is current once its list is written, so a failed write leaves the one before it
    in place. One writer at a time. An update compacts when there are more than max_deltas deltas, or when their points are more than max_share
    of all.
    """

    spark: SparkSession
    base: str
    name: str
    parts: int = 32
    max_deltas: int = 16
    max_share: float = 0.25
    _kept: list[DataFrame] = field(default_factory=list, repr=False)

    @property
    def root(self) -> str:
        return f"{self.base.rstrip('/')}/{self.name}"

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _folders(self, below: str = "") -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.root}{below}")
        if not fs.exists(at):
            return []
        return sorted(int(n[2:]) for n in (s.getPath().getName() for s in fs.listStatus(at)) if n.startswith("v="))

    def versions(self) -> list[int]:
        """The complete versions."""
        fs, path = self._fs()
        return [n for n in self._folders() if fs.exists(path(f"{self.root}/v={n}/parts/_SUCCESS"))]

    def exists(self) -> bool:
        return bool(self.versions())

    def _list(self) -> list:
        """The current version's list: at most `parts` parts, max_deltas + 1 deltas and as many changes."""
        return self.spark.read.schema(_LIST).json(f"{self.root}/v={self.versions()[-1]}/parts").collect()

    @staticmethod
    def _of(listed: list, part: int) -> list[int]:
        return sorted(r["version"] for r in listed if r["part"] == part)

    def deltas(self) -> list[int]:
        """The versions whose deltas the current version has, in order."""
        return self._of(self._list(), _DELTA)

    def count(self) -> int:
        """How many points there are, as kept with the version."""
        return next(r["n"] for r in self._list() if r["part"] == _SCHEMAS)

    def frequencies(self, tokens: DataFrame | None = None) -> DataFrame:
        """(token, df) over all points, as kept with the versions; tokens: of these (token) only."""
        changes = self._tagged("changes", self._of(self._list(), _CHANGES), _FREQUENCIES)
        if tokens is not None:
            changes = changes.join(tokens.select("token").distinct(), "token", "left_semi")
        return changes.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def _listed(self) -> dict[int, int]:
        """part of the base -> the version whose folder holds it."""
        return {r["part"]: r["version"] for r in self._list() if r["part"] >= 0}

    @staticmethod
    def _schema(listed: list, table: str = "points") -> StructType:
        stored = StructType.fromJson(json.loads(next(r for r in listed if r["part"] == (_TEXTS if table == "texts" else _SCHEMAS))["schema"]))
        return _of_terms(stored) if table == "terms" else stored

    @staticmethod
    def _has_texts(listed: list) -> bool:
        return any(r["part"] == _TEXTS for r in listed)

    def _tagged(self, table: str, versions: list[int], schema: StructType) -> DataFrame:
        """What some versions have of one of _TABLES, with v, the version."""
        whole = StructType([*schema.fields, StructField("v", IntegerType())])
        if not versions:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/v={v}" for v in versions])

    def _base(self, listed: list, table: str, only: set[int] | None = None) -> DataFrame:
        schema = self._schema(listed, table)
        paths = [f"{self.root}/v={r['version']}/{table}/part={r['part']}" for r in sorted(listed) if r["part"] >= 0 and (only is None or r["part"] in only)]
        if table == "texts":  # a part may have points, but no first chunk
            fs, path = self._fs()
            paths = [p for p in paths if fs.exists(path(p))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _gone(self, listed: list, deltas: list[int]) -> dict[str, DataFrame]:
        """For each key, (key, __key): the last of some deltas that takes it away."""
        schema = self._schema(listed)
        return {key: self._last(self._tagged(table, deltas, StructType([schema[key]])), key) for key, table in _GONE.items() if key in schema.names}

    @staticmethod
    def _last(taken: DataFrame, key: str) -> DataFrame:
        """(key, __key): the last version v that takes it away; up to ALONG rows go along with what they are joined with, which is not shuffled then."""
        last = taken.groupBy(key).agg(F.max("v").alias(f"__{key}"))
        return F.broadcast(last) if taken.count() <= ALONG else last

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """A delta's rows by parts, as the base's lie."""
        return self._part(rows).hint("rebalance", "part").drop("part")

    @staticmethod
    def _taken(gone: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
        """rows with __taken: the last delta that takes their article or point away, -1 without one."""
        for key, last in gone.items():
            rows = rows.join(last, key, "left")
        last = F.greatest(F.lit(-1), *(F.coalesce(f"__{key}", F.lit(-1)) for key in gone))
        return rows.withColumn("__taken", last).drop(*(f"__{key}" for key in gone))

    def _dead(self, gone: dict[str, DataFrame], keys: DataFrame, id_: str) -> list[tuple[set[int], DataFrame]]:
        """Of base rows' keys: groups of parts, and the ids in each that are taken away, up to ALONG of them (or one part's); only keys are shuffled, and the saved ids are read again by each use."""
        mine = saved(self._taken(gone, self._part(keys)).where("__taken >= 0").select("part", id_), "dead")
        held = {r["part"]: r["count"] for r in mine.groupBy("part").count().collect()}  # self.parts rows at most
        groups, size = [set()], 0
        for part in range(self.parts):
            if groups[-1] and size + held.get(part, 0) > ALONG:
                groups, size = [*groups, set()], 0
            groups[-1].add(part)
            size += held.get(part, 0)
        some = lambda parts: mine.where(F.col("part").isin(*parts)).select(id_).distinct()
        near = lambda parts: F.broadcast(some(parts)) if sum(held.get(p, 0) for p in parts) <= ALONG else some(parts)
        return [(parts, near(parts)) for parts in groups]

    def _touched(self, listed: list, gone: dict[str, DataFrame], deltas: list[int]) -> set[int]:
        """The base's parts with points that are taken away, and those that some deltas' points belong to; reads ids alone."""
        schema = self._schema(listed)
        keys = [c for c in _GONE if c in schema.names]
        taken = self._taken(gone, self._part(self._base(listed, "points").select(*keys))).where("__taken >= 0").select("part")
        brought = self._part(self._tagged("delta_points", deltas, schema).select(*keys)).select("part")
        return set(self._written(taken.unionByName(brought)))

    def _read(self, table: str, only: set[int] | None = None, listed: list | None = None, dealt: bool = False) -> DataFrame:
        """The living rows of the base (of some parts only) and of the deltas; dealt: by parts, both."""
        listed = listed or self._list()
        base, deltas, schema = self._base(listed, table, only), self._of(listed, _DELTA), self._schema(listed, table)
        if not deltas:
            return base
        brought = self._tagged(f"delta_{table}", deltas, schema)
        both = base.withColumn("v", F.lit(0)).unionByName(self._dealt(brought) if dealt else brought)
        return self._taken(self._gone(listed, deltas), both).where("__taken <= v").select(*schema.names)

    def _parts_of(self, listed: list, filter_: Mapping | None) -> set[int] | None:
        """The parts that have what a filter may keep: fewer than all where it names articles."""
        articles = None if filter_ is None or "article_id" not in self._schema(listed).names else named(filter_)
        if articles is None:
            return None
        key = self.spark.createDataFrame([(a,) for a in articles], StructType([self._schema(listed)["article_id"]]))
        return set(self._written(self._part(key)))

    def points(self, where: Mapping | None = None) -> DataFrame:
        """All points, or those that a filter keeps (operators.filters); one that names articles reads their parts only."""
        listed = self._list()
        rows = self._read("points", self._parts_of(listed, where), listed)
        return rows if where is None else rows.where(compiled(where, rows))

    def terms(self, where: Mapping | None = None) -> DataFrame:
        """(point_id, terms array<struct<token, tf>>); where: of the parts at least that have what the filter keeps."""
        listed = self._list()
        return self._read("terms", self._parts_of(listed, where), listed).select("point_id", "terms")

    def texts(self) -> DataFrame | None:
        """(article_id, article_text) of the articles; None where points keep what they were given."""
        listed = self._list()
        if not self._has_texts(listed):
            return None
        deltas, base = self._of(listed, _DELTA), self._base(listed, "texts")
        return self._living_texts(listed, base) if deltas else base

    def _living_texts(self, listed: list, base: DataFrame, dealt: bool = False) -> DataFrame:
        """Of some base texts and the deltas', those that no later delta takes away or brings anew."""
        deltas, schema = self._of(listed, _DELTA), self._schema(listed, "texts")
        brought = self._tagged("delta_texts", deltas, schema)
        key = StructType([schema["article_id"]])
        gone = self._tagged("gone_articles", deltas, key).unionByName(brought.select("article_id", "v"))
        last = {"article_id": self._last(gone, "article_id")}
        return self._taken(last, base.withColumn("v", F.lit(0)).unionByName(self._dealt(brought) if dealt else brought)).where("__taken <= v").select(*schema.names)

    def with_texts(self, hits: DataFrame) -> DataFrame:
        """Found points with their articles' texts; without an article null. Only found articles' texts leave their parts, where their ids are few by size."""
        texts = self.texts()
        if texts is None:
            return hits
        hits = saved(hits, "found")
        keys = saved(hits.select("article_id").where("article_id is not null").distinct(), "found-articles")
        return hits.join(texts.join(keys, "article_id", "left_semi"), "article_id", "left")

    def postings(self) -> DataFrame:
        """(point_id, token, tf)."""
        return self.terms().select("point_id", F.inline("terms"))

    def create(self, points: DataFrame, recreate: bool = False, text_col: str = "chunk_text", stops: tuple[str, ...] = (), min_length: int = 2) -> None:
        """Write the first version; an existing collection stays unless recreate, and then until the new one is complete."""
        if self.exists() and not recreate:
            return
        n = self._next()
        points, texts = _split(points)
        rows = self._write_parts(points, points.schema, "points", n)
        found = self._write_parts(self._terms(rows, text_col, stops, min_length), _of_terms(points.schema), "terms", n, True)
        sweep(self.spark)  # the points' shuffle files; else they stay beside the texts'
        self._write(vocabulary(found.select("point_id", F.inline("terms"))), "changes", n)
        if texts is not None:
            self._write_parts(texts, texts.schema, "texts", n)
        self._finish(n, {p: n for p in self._written(rows)}, [], [n], points.schema, rows.count(), None if texts is None else texts.schema)
        self.vacuum()

    def _next(self) -> int:
        return max([0, *self._folders(), *(v for t in _TABLES for v in self._folders(f"/{t}"))]) + 1

    def _part(self, df: DataFrame) -> DataFrame:
        key = "article_id" if "article_id" in df.columns else "point_id"
        return df.withColumn("part", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.parts)).cast("int"))

    def _write(self, df: DataFrame, table: str, n: int) -> None:
        # rebalancing joins small tasks, so a small update writes few files
        df.hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/{table}/v={n}")

    @staticmethod
    def _terms(rows: DataFrame, text_col: str, stops: tuple[str, ...], min_length: int) -> DataFrame:
        return terms(rows, "point_id", text_col, stops, min_length, [c for c in ("article_id",) if c in rows.columns])

    def _write_parts(self, df: DataFrame, schema: StructType, table: str, n: int, dealt: bool = False, mode: str = "overwrite") -> DataFrame:
        """df as parts of version n, read again with its part; rebalancing splits a large part among tasks and joins small ones. dealt: df lies by parts
        already, as it was read from them, and is not shuffled.
        """
        at = f"{self.root}/v={n}/{table}"
        placed = self._part(df)
        (placed if dealt else placed.hint("rebalance", "part")).write.mode(mode).partitionBy("part").parquet(at)
        return self.spark.read.schema(StructType([*schema.fields, StructField("part", IntegerType())])).parquet(at)

    @staticmethod
    def _written(rows: DataFrame) -> list[int]:
        return sorted(r["part"] for r in rows.select("part").distinct().collect())  # self.parts rows at most

    def _finish(self, n: int, parts: dict[int, int], deltas: list[int], changes: list[int], schema: StructType, count: int, texts: StructType | None) -> None:
        """The list of version n, which makes it the current one."""
        rows = [(p, v, None, None) for p, v in sorted(parts.items())] + [(_DELTA, v, None, None) for v in deltas] + [(_CHANGES, v, None, None) for v in changes]
        rows.append((_SCHEMAS, n, schema.json(), count))
        if texts is not None:
            rows.append((_TEXTS, n, texts.json(), None))
        self.spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("overwrite").json(f"{self.root}/v={n}/parts")

    def upsert(self, new: DataFrame, text_col: str = "chunk_text", stops: tuple[str, ...] = (), min_length: int = 2, whole_articles: bool = True) -> None:
        """A new version with the rows of new in place of equal point ids; nothing happens for an empty table.

        whole_articles: the points of an article in new that new does not have go, so no chunk of an old text stays.
        What is written follows new; a compaction, when one is due, rewrites the parts that the deltas touch.
        """
        if new.isEmpty():
            return
        latest = upsert(new.drop("batch").limit(0), new)
        if not self.exists():
            self.create(latest, False, text_col, stops, min_length)
            return
        listed, n = self._list(), self._next()
        if self._has_texts(listed):
            latest, texts = _split(latest)
            none = self.spark.createDataFrame([], self._schema(listed, "texts"))
            self._write(none if texts is None else none.unionByName(texts), "delta_texts", n)
        old = self._schema(listed)
        schema = StructType([*old.fields, *(f for f in latest.schema.fields if f.name not in old.names)])
        self._write(self.spark.createDataFrame([], schema).unionByName(latest, allowMissingColumns=True), "delta_points", n)
        added = self._tagged("delta_points", [n], schema).drop("v")
        self._write(self._terms(added, text_col, stops, min_length), "delta_terms", n)
        both = whole_articles and "article_id" in old.names and "article_id" in latest.columns
        self._take(listed, n, added.select("article_id").distinct() if both else None, added.select("point_id"), schema, [n])

    def delete(self, articles: DataFrame) -> None:
        """A new version without the points of these articles (article_id)."""
        listed, n = self._list(), self._next()
        self._take(listed, n, articles.select("article_id").distinct(), None, self._schema(listed), [])

    def _take(self, listed: list, n: int, articles: DataFrame | None, ids: DataFrame | None, schema: StructType, added: list[int]) -> None:
        """Finish version n, a delta that takes articles and points away and adds its own points."""
        kinds = {"article_id": articles, "point_id": ids}
        for key, table in _GONE.items():
            if key in schema.names:
                none = self.spark.createDataFrame([], StructType([schema[key]]))
                self._write((none if kinds[key] is None else none.unionByName(kinds[key])).where(F.col(key).isNotNull()), table, n)
        for table in () if added else ("points", "terms", *(("texts",) if self._has_texts(listed) else ())):
            self._write(self.spark.createDataFrame([], self._schema(listed, table)), f"delta_{table}", n)
        mine = self._gone(listed, [n])
        touched = self._touched(listed, mine, [])
        if not self._of(listed, _DELTA) and not self._near(listed, [n]):  # the lists are too long to go along: first which points they take
            groups = self._dead(mine, self._base(listed, "points", touched).select(*(c for c in _GONE if c in self._schema(listed).names)), "point_id")
            each = [self._base(listed, "terms", touched & parts).join(ids, "point_id", "left_semi").select("point_id", "terms") for parts, ids in groups]
            gone = saved(reduce(DataFrame.unionByName, each), "gone")
        else:
            gone = saved(self._taken(mine, self._read("terms", touched, listed)).where("__taken >= 0").select("point_id", "terms"), "gone")
        plus = self._tagged("delta_terms", added, _of_terms(schema)).select("point_id", F.inline("terms"))
        minus = gone.select("point_id", F.inline("terms"))
        changes = vocabulary(plus).unionByName(vocabulary(minus).withColumn("df", -F.col("df"))).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
        self._write(changes, "changes", n)
        more = self._tagged("delta_points", added, schema).count()
        count = next(r["n"] for r in listed if r["part"] == _SCHEMAS) + more - gone.count()
        forget(gone)
        deltas = [*self._of(listed, _DELTA), n]
        self._finish(n, {r["part"]: r["version"] for r in listed if r["part"] >= 0}, deltas, [*self._of(listed, _CHANGES), n], schema, count, self._schema(listed, "texts") if self._has_texts(listed) else None)
        if len(deltas) > self.max_deltas or self._tagged("delta_points", deltas, schema).count() > self.max_share * max(count, 1):
            self.compact()


    def compact(self) -> None:
        """Fold the deltas into new folders of the parts that they touch, and the changes of frequencies into one."""
        listed = self._list()
        deltas = self._of(listed, _DELTA)
        if not deltas:
            return
        n, schema = self._next(), self._schema(listed)
        touched = self._touched(listed, self._gone(listed, deltas), deltas)
        texts = self._schema(listed, "texts") if self._has_texts(listed) else None
        tables = [("points", schema), ("terms", _of_terms(schema)), *([("texts", texts)] if texts is not None else [])]
        # the base lies by parts and is not shuffled: what is taken away goes along, or, where that is too long, what it takes of a group of parts
        if self._near(listed, deltas):
            for table, kinds in tables:
                living = self._living_texts(listed, self._base(listed, table, touched), True) if table == "texts" else self._read(table, touched, listed, True)
                self._write_parts(living, kinds, table, n, True)
        else:
            for table, kinds in tables:
                self._fold(listed, deltas, touched, table, kinds, n)
        sweep(self.spark)
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("part", IntegerType())])).parquet(f"{self.root}/v={n}/points")
        self._write(self.frequencies(), "changes", n)
        others = {r["part"]: r["version"] for r in listed if r["part"] >= 0 and r["part"] not in touched}
        self._finish(n, others | {p: n for p in self._written(rows)}, [], [n], schema, self.count(), texts)

    def _near(self, listed: list, deltas: list[int]) -> bool:
        """Whether the lists of what some deltas take away go along with the rows."""
        tables = [*(t for key, t in _GONE.items() if key in self._schema(listed).names), *(("delta_texts",) if self._has_texts(listed) else ())]
        return sum(self._tagged(t, deltas, StructType([])).count() for t in tables) <= ALONG

    def _fold(self, listed: list, deltas: list[int], touched: set[int], table: str, kinds: StructType, n: int) -> None:
        """One table of a compaction by groups of parts, as they lie; of the base only keys are shuffled."""
        key = "article_id" if table == "texts" else "point_id"
        gone, brought = self._gone(listed, deltas), self._tagged(f"delta_{table}", deltas, kinds)
        if table == "texts":
            taken = self._tagged("gone_articles", deltas, StructType([kinds[key]])).unionByName(brought.select(key, "v"))
            gone = {key: self._last(taken, key)}
        base = self._base(listed, table, touched)
        fresh = self._part(self._taken(gone, brought).where("__taken <= v").select(*kinds.names))
        for parts, ids in self._dead(gone, base.select(*(c for c in _GONE if c in kinds.names)), key):
            living = self._base(listed, table, touched & parts).join(ids, key, "left_anti").select(*kinds.names)
            mine = fresh.where(F.col("part").isin(*parts)).hint("rebalance", "part").select(*kinds.names)
            self._write_parts(living.unionByName(mine), kinds, table, n, True, "append")

    def vacuum(self) -> None:
        """Delete what the current version does not list."""
        if not self.exists():
            return
        fs, path = self._fs()
        listed = self._list()
        current, parts = self.versions()[-1], self._listed()
        for v in self._folders():
            mine = {p for p, w in parts.items() if w == v}
            if v != current and not mine:
                fs.delete(path(f"{self.root}/v={v}"), True)
            elif v != current:
                for table in (t for t in ("points", "terms", "texts") if fs.exists(path(f"{self.root}/v={v}/{t}"))):
                    for s in fs.listStatus(path(f"{self.root}/v={v}/{table}")):
                        name = s.getPath().getName()
                        if name.startswith("part=") and int(name[5:]) not in mine:
                            fs.delete(s.getPath(), True)
        for table in _TABLES:
            used = self._of(listed, _CHANGES if table == "changes" else _DELTA)
            for v in self._folders(f"/{table}"):
                if v not in used:
                    fs.delete(path(f"{self.root}/{table}/v={v}"), True)

    def info(self, vector_col: str = "embedding") -> DataFrame:
        """One row: name, vector_size (of some point's vector), points_count, status; no scan."""
        kind = "name string, vector_size int, points_count bigint, status string"
        if not self.exists():
            return self.spark.createDataFrame([(self.name, None, 0, "missing")], kind)
        p = self.points()
        some = p.where(F.col(vector_col).isNotNull()).select(F.size(vector_col)).first() if vector_col in p.columns else None
        return self.spark.createDataFrame([(self.name, some and some[0], self.count(), "green")], kind)

    def cache(self) -> tuple[DataFrame, DataFrame]:
        """Points and terms, kept in memory until close()."""
        self._kept += [self.points().persist(), self.terms().persist()]
        return self._kept[-2], self._kept[-1]

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)

    def close(self) -> None:
        """Free what cache() kept; other tables of the session stay."""
        while self._kept:
            self._kept.pop().unpersist()
