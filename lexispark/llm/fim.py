"""Fill-in-middle texts: a text's units are cut at two ranks and its middle goes to the end, behind marks.

A unit is a word with the white space before it, or the white space that ends a text. A text is read by two streaming
passes of the matcher: the first counts the units, the second advances a lazy match iterator to both ranks and stops
there. No array of units is ever stored, so besides the text itself the memory is the same for a text of any length.

Ranks and form come from the SHA-256 of `seed:id`, so a row's result depends on nothing but the row.

Defined results: a null text is the empty text, which stays plain, as do texts that contain a mark; a null id
counts as an empty one, so such rows share their hash; rows that repeat an id are rows of their own, with equal results
for equal texts; where both ranks are equal the middle is empty; texts of any length are taken whole; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import prepare, text_or_empty

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Params:
    """seed goes into each row's hash; rate: percent of texts that are cut; spm: percent of those that begin with the suffix."""

    seed: str = "42"
    rate: int = 50
    spm: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = self.marks
        if not all(marks) or len(set(marks)) < 3 or any(c in m[1:] for m in marks for c in {x[0] for x in marks}):
            raise ValueError("three different marks are needed, whose first characters occur nowhere else in them")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def count_units(text: str) -> int:
    """First pass: how many units there are."""
    return sum(1 for _ in UNIT.finditer(text))


def cut_points(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the units number low and high (low <= high, counted from 1; 0: the beginning) end."""
    units, passed, at, ends = UNIT.finditer(text), 0, 0, []
    for rank in (low, high):
        if rank > passed:
            at, passed = next(islice(units, rank - passed - 1, None)).end(), rank
        ends.append(at)
    return ends[0], ends[1]


def rearranged(text: str, key: str, p: Params) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and of middle, output) of a text whose hash is that of key."""
    n = count_units(text)
    digest = hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))
    if not text or h3 % 100 >= p.rate or any(m in text for m in p.marks):
        return n, PLAIN, None, None, text
    a, b = cut_points(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < p.spm:
        form, output = SPM, "".join((p.suffix, text[b:], p.prefix, text[:a], p.middle, text[a:b]))
    else:
        form, output = PSM, "".join((p.prefix, text[:a], p.suffix, text[b:], p.middle, text[a:b]))
    return n, form, a, b - a, output


def restored(output: str, form: str, p: Params) -> str:
    """The text from an output and its form. No mark is in the text, and none can arise across a cut, as no mark has another's first character within."""
    if form == PLAIN:
        return output
    first, second = (p.suffix, p.prefix) if form == SPM else (p.prefix, p.suffix)
    if not output.startswith(first):
        raise ValueError("the output does not begin with its form's mark")
    one, found, rest = output[len(first) :].partition(second)
    two, also, middle = rest.partition(p.middle)
    if not (found and also):
        raise ValueError("the output lacks a mark")
    return two + middle + one if form == SPM else one + middle + two


def transform(df: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; without a shuffle."""
    prepare(df.sparkSession)
    key = F.concat(F.lit(params.seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), key.alias("key"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [rearranged(t.as_py(), k.as_py(), params) for k, t in zip(b.column(1), b.column(2))]
            columns = list(zip(*made)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["id", *names])

    out = rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("id", id_col)


def restore(made: DataFrame, params: Params = Params(), col: str = "restored") -> DataFrame:
    """transform()'s rows with the text that output and form give back."""
    prepare(made.sparkSession)

    @F.arrow_udf("string")
    def text(output: pa.Array, form: pa.Array) -> pa.Array:
        return pa.array([restored(o.as_py(), f.as_py(), params) for o, f in zip(output, form)], pa.string())

    return made.withColumn(col, text("output", "form"))


def digests(df: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    made = restore(transform(df, params, id_col, text_col), params)
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: digests() with the default parameters, for DuckDB.
ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), numbers AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM units
), parts AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM numbers
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
