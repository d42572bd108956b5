"""Words, paragraphs, chunks and tokens of a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.config import Chunking

#: Letters, digits and the underscore of any script.
TOKEN = r"[\p{L}\p{N}_]+"
_SPACES = r"(?U)\s+"


def words(text: Column) -> Column:
    """Runs of characters that are no white space of any script."""
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fixed_chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Sliding windows of words; a text of at most `size` words stays as it is, a blank one gives none."""
    w, step = words(text), size - overlap
    n = F.size(w)
    slices = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))
    return F.when(text.isNull() | (n == 0), F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(slices)


def paragraphs(text: Column, separators: Sequence[str] = ("\n\n", ";\n")) -> Column:
    """Trimmed non-empty paragraphs: split at the first separator, then, where it occurs, at the second."""
    first, second = (f"\\Q{s}\\E" for s in separators)
    trimmed = lambda a: F.filter(F.transform(a, strip), lambda p: p != "")
    outer = trimmed(F.split(F.coalesce(text, F.lit("")), first))
    return F.flatten(F.transform(outer, lambda p: trimmed(F.split(p, second))))


def paragraph_words(text: Column, c: Chunking) -> Column:
    """array<struct<text, ws>>: paragraphs with their words, so that words are split once."""
    return F.transform(paragraphs(text, c.separators), lambda p: F.struct(p.alias("text"), words(p).alias("ws")))


def children(paras: Column, c: Chunking) -> Column:
    """array<struct<child_idx, child_text, n>> of paragraph_words(): paragraphs within the limits, and slices of longer ones.

    A paragraph's child_idx is its place among the paragraphs; a slice's is its place among the children. n: words.
    """

    def pieces(p: Column, i: Column) -> Column:
        n = F.size(p["ws"])
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(c.child_max)), lambda s: F.least(n - s, F.lit(c.child_max)) >= c.child_min)
        own = lambda t, k, m: F.struct(k.cast("int").alias("para"), t.alias("text"), m.cast("int").alias("n"))
        return (
            F.when((n >= c.child_min) & (n <= c.child_max), F.array(own(p["text"], i, n)))
            .when(n > c.child_max, F.transform(starts, lambda s: own(F.array_join(F.slice(p["ws"], s + 1, F.lit(c.child_max)), " "), F.lit(None), F.least(n - s, F.lit(c.child_max)))))
            .otherwise(F.array().cast("array<struct<para:int,text:string,n:int>>"))
        )

    return F.transform(F.flatten(F.transform(paras, pieces)), lambda x, i: F.struct(F.coalesce(x["para"], i).alias("child_idx"), x["text"].alias("child_text"), x["n"].alias("n")))


def parents(kids: Column, text: Column, article_id: Column, c: Chunking) -> Column:
    """array<struct<parent_id, parent_text, children>> of a children() column; a text without any is one parent and child."""
    step = c.children_per_parent - (1 if c.parent_overlap else 0)
    joined = lambda g: F.array_join(F.transform(g, lambda x: x["child_text"]), "\n\n")
    name = lambda number: F.concat(article_id.cast("string"), F.lit("_p"), number.cast("string"))

    def size(i: Column) -> Column:
        """Children of the group that begins at i: two where all would be too many words."""
        total = F.aggregate(F.slice(kids, i + 1, F.lit(c.children_per_parent)), F.lit(0), lambda s, x: s + x["n"])
        return F.when(total > c.parent_max, 2).otherwise(c.children_per_parent)

    def group(i: Column, number: Column) -> Column:
        g = F.slice(kids, i + 1, size(i))
        return F.struct(name(number).alias("parent_id"), joined(g).alias("parent_text"), g.alias("children"))

    whole = F.coalesce(text, F.lit(""))
    alone = F.array(F.struct(name(F.lit(0)).alias("parent_id"), whole.alias("parent_text"), F.array(F.struct(F.lit(0).alias("child_idx"), whole.alias("child_text"), F.lit(0).alias("n"))).alias("children")))
    return F.when(F.size(kids) == 0, alone).otherwise(F.transform(F.sequence(F.lit(0), F.size(kids) - 1, F.lit(step)), group))


def tokens(text: Column, stop_words: Sequence[str] = (), min_length: int = 2) -> Column:
    """Lower-cased tokens that are long enough and no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    keep = F.filter(found, lambda t: F.length(t) >= min_length)
    if not stop_words:
        return keep
    return F.filter(keep, lambda t: ~t.isin(*stop_words))  # a set of literals: one look-up for a token, however many there are


def truncate(text: Column, n: int = 8000) -> Column:
    return F.substring(text, 1, n)
