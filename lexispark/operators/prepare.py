"""From raw statute texts to articles, pairs, splits and negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import strip

#: Numbers in file names and the codes they mean.
CODE_NUMBERS = {
    "63": "Уголовный кодекс РФ",
    "51": "Гражданский кодекс РФ",
    "145": "Бюджетный кодекс РФ",
    "188": "Жилищный кодекс РФ",
    "197": "Трудовой кодекс РФ",
}
#: What is looked for in a text's beginning, in this order, and the codes' numbers.
CONTENT_STEMS = (("жилищный кодекс", "188"), ("жилищное", "188"), ("трудов", "197"), ("уголовн", "63"), ("гражданск", "51"), ("бюджетн", "145"))
#: Stems and numbers, in the order in which they are tried in a file name.
NAME_STEMS = (("уголовн", "63"), ("гражданск", "51"), ("бюджет", "145"), ("трудов", "197"), (None, "188"))
UNKNOWN_CODE = "Неизвестный кодекс"


def classify_code(name: Column, content: Column) -> Column:
    """The code by the number after N in the file name, else by the text's beginning, else by the name."""
    numbers = F.create_map(*[F.lit(x) for kv in CODE_NUMBERS.items() for x in kv])
    by_number = F.try_element_at(numbers, F.regexp_extract(name, r"N\s+(\d+)", 1))
    head, low = F.lower(F.substring(F.coalesce(content, F.lit("")), 1, 1000)), F.lower(name)
    first = lambda pairs: F.coalesce(*[F.when(test, CODE_NUMBERS[n]) for test, n in pairs])
    by_content = first([(head.contains(stem), n) for stem, n in CONTENT_STEMS])
    by_name = first([((low.contains(stem) | name.contains(n)) if stem else name.contains(n), n) for stem, n in NAME_STEMS])
    return F.coalesce(by_number, by_content, by_name, F.lit(UNKNOWN_CODE))


# What begins an article, what is a chapter's heading within one, and what no article's text begins with.
_HEAD = r"(?mdiuU)(?:^|\n)\s*(?:Статья)\s+(\d+(?:\.\d+)?)[\.:]?\s*"
_CHAPTER = r"(?mdiuU)^(?:Глава|Раздел|Часть)\s+\d+[\.:]?\s*.*?\n"
_HEADING_LIKE = r"(?U)^(?:Глава|Раздел|Часть|ЧАСТЬ|ГЛАВА|РАЗДЕЛ)\s+\d+"
_POINT = r"(?mdU)^\s*\d+\.\s+"
_SENTENCE = r"(?U)^([^.]+\.\s+[А-Я])"


def split_articles(files: DataFrame, text_col: str = "text", min_body: int = 30) -> DataFrame:
    """One row per article: the columns of files but the text, pos, article_num, article_title, article_text.

    Headings are marked by control characters and split at them; what stands before the first heading goes. An
    article's text, without chapter headings and outer white space, is title and body: the title is what stands before
    the first numbered point, else the first line if it is no longer than 199 characters and others follow, else the
    first line of a sentence that another one follows, with that one's first letter. Bodies of at most min_body
    characters, and bodies that are headings themselves, go. The control characters U+0001 and U+0002 are no text and go.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n|\r", "\n"), r"[ \t]+", " ")
    text = F.translate(text, "\u0001\u0002", "")
    pieces = F.slice(F.split(F.regexp_replace(text, _HEAD, "\u0001$1\u0002"), "\u0001"), 2, 1_000_000_000)
    rest = [c for c in files.columns if c != text_col]
    rows = files.select(*rest, F.posexplode(pieces).alias("pos", "piece"))
    # columns in steps: each is used more than once by the next
    rows = rows.withColumn("article_num", F.substring_index("piece", "\u0002", 1)).withColumn("raw", strip(F.regexp_replace(F.expr("substring(piece, instr(piece, '\u0002') + 1)"), _CHAPTER, "")))
    rows = rows.withColumn("at", F.regexp_instr("raw", F.lit(_POINT))).withColumn("line", F.substring_index("raw", "\n", 1)).withColumn("sentence", F.regexp_extract("raw", _SENTENCE, 1))
    first_line = (F.instr("raw", "\n") > 0) & (F.length("line") < 200)
    rows = rows.withColumn("title", F.when(F.col("at") > 0, F.expr("substring(raw, 1, at - 1)")).when(first_line, F.col("line")).when(F.col("sentence") != "", strip(F.substring_index("sentence", "\n", 1))).otherwise(""))
    body = F.when(F.col("at") > 0, F.expr("substring(raw, at)")).otherwise(F.expr("substring(raw, length(title) + 1)"))
    one_line = strip(F.regexp_replace("title", r"\n+", " "))
    made = F.struct("pos", "article_num", one_line.alias("article_title"), strip(F.regexp_replace(strip(body), r"(?U)\n\s*\n+", "\n")).alias("article_text"))
    # as a generator: a filter would be moved below the steps, and each of them made again for every use
    kept = F.filter(F.array(made), lambda x: (F.length(x["article_text"]) > min_body) & ~x["article_text"].rlike(_HEADING_LIKE))
    return rows.select(*rest, F.inline(kept))


def number_key(num: Column) -> Column:
    """The number's leading integer."""
    digits = F.regexp_extract(num, r"(\d+)", 1)
    return F.when(digits != "", digits).cast("double")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a stated order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def sort_articles(df: DataFrame, order: list[str]) -> DataFrame:
    """By code, then the number's leading integer, then the source's order."""
    return df.orderBy("codex", number_key(F.col("article_num")), *order)


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def any_null(df: DataFrame) -> DataFrame:
    """Rows with a null in any column."""
    test = F.lit(False)
    for c in df.columns:
        test = test | F.col(c).isNull()
    return df.where(test)


def pairs(articles: DataFrame, min_length: int = 10) -> DataFrame:
    """Query and positive article: queries that are long enough, each once (the smallest article_id stays)."""
    a = require_columns(articles, ["article_id", "article_num", "article_title", "article_text", "codex", "query_text"])
    good = a.where(F.col("query_text").isNotNull() & (F.length("query_text") >= min_length))
    once = keep_first(good, ["query_text"], ["article_id"])
    return once.select(F.col("article_id").alias("query_id"), "query_text", "article_id", "article_num", F.coalesce("article_title", F.lit("")).alias("article_title"), "article_text", "codex")


def split_key(id_col: str, seed: int = 42, of: int = 10007) -> Column:
    """A portable pseudo-random key from 0 to of - 1."""
    return F.pmod(F.pmod(F.col(id_col).cast("bigint"), F.lit(of)) * 7919 + seed * 104729, F.lit(of))


def ordered(df: DataFrame, group: str, key: Column, id_col: str) -> DataFrame:
    """df with place (from 0 on, by key and then id) and n, both within the group.

    Rows are counted by group and key first, so a place is the count of the smaller keys and a rank among the rows of one
    key: a group that has a third of all rows is spread over as many tasks as it has keys.
    """
    keyed = df.withColumn("__key", key)
    sizes = keyed.groupBy(F.col(group).alias("__group"), F.col("__key").alias("__of")).agg(F.count("*").alias("__size"))
    before = Window.partitionBy("__group").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).withColumn("n", F.sum("__size").over(Window.partitionBy("__group")))
    rank = F.row_number().over(Window.partitionBy(group, "__key").orderBy(id_col)) - 1
    both = keyed.withColumn("__rank", rank).join(sizes, F.col(group).eqNullSafe(F.col("__group")) & F.col("__key").eqNullSafe(F.col("__of")))
    return both.select(*df.columns, (F.col("__before") + F.col("__rank")).alias("place"), "n")


def stratified_split(df: DataFrame, id_col: str = "query_id", stratum: str = "codex", share: float = 0.15, seed: int = 42) -> DataFrame:
    """df with is_test: round(share * n) rows of each stratum."""
    placed = ordered(df, stratum, split_key(id_col, seed), id_col)
    return placed.select(*df.columns, (F.col("place") < F.floor(F.col("n") * share + 0.5)).alias("is_test"))


def negatives(pairs_: DataFrame, articles: DataFrame, per_positive: int = 4, seed: int = 42, how: str = "same_codex", ring: int = 1000) -> DataFrame:
    """(query_id, article_id, negative_id): other articles, per_positive each where there are enough.

    how: "same_codex" takes articles of the same code, "random" any, and "in_batch" the articles of other pairs. The
    candidates stand on rings in a pseudo-random order, one for each code or of about `ring` candidates; a query takes
    the next ones after its own, so no pairs of a whole ring are made.
    """
    if how not in ("same_codex", "random", "in_batch"):
        raise ValueError(f"unknown negatives: {how}")
    every = pairs_.select("article_id").where("article_id is not null").distinct() if how == "in_batch" else articles
    if how == "same_codex":
        every = every.select("article_id", F.col("codex").alias("ring"))
    else:
        rings = max(1, every.count() // ring)
        every = every.select("article_id", F.pmod(split_key("article_id", seed, 1000003), F.lit(rings)).alias("ring"))
    placed = ordered(every, "ring", split_key("article_id", seed), "article_id")
    mine = pairs_.select("query_id", "article_id").join(placed, "article_id")
    wanted = mine.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(per_positive)))).where("step < n")
    wanted = wanted.select("query_id", "article_id", "ring", F.pmod(F.col("place") + F.col("step"), F.col("n")).alias("place"))
    return wanted.join(placed.select(F.col("article_id").alias("negative_id"), "ring", "place"), ["ring", "place"]).select("query_id", "article_id", "negative_id")


def category_counts(df: DataFrame, col: str = "codex") -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n_before, n_after, n_removed)."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(before, "n_before").crossJoin(n(after, "n_after")).withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def profile(articles: DataFrame, sample: int = 5, seed: int = 42) -> dict[str, DataFrame]:
    """Counts, counts by code, the first articles, and as many in a pseudo-random order, the same for every run."""
    mixed = articles.orderBy(split_key("article_id", seed, 1000003), "article_id").limit(sample)
    return {"total": articles.agg(F.count("*").alias("n")), "by_code": category_counts(articles), "head": articles.orderBy("article_id").limit(sample), "sample": mixed}
