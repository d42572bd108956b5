"""Payload filters as data: nested conditions compiled into one column expression.

A filter is a mapping, as read from JSON:

    {"must": [...], "should": [...], "must_not": [...]}     all of must, some of should, none of must_not
    {"key": "codex", "match": {"value": "x"}}               also {"any": [...]}, {"except": [...]} and {"text": "part of it"}
    {"key": "article_id", "range": {"gte": 10, "lt": 20}}   gt, gte, lt, lte
    {"is_null": {"key": "codex"}}
    {"has_id": [1, 2]}                                      points by their ids

Each condition may itself be such a mapping. A condition on a null value does not hold, so it is no reason to leave a
row out under must_not. Negations are moved to the conditions themselves, so that Spark can hand each to the scan.

Defined results: an empty filter holds for every row, and so does an empty list of must, should or must_not; a key
that the table lacks, a condition that is no mapping and an unknown word are errors; keys with dots name fields of structs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GROUPS = ("must", "should", "must_not")
_RANGE = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
_NOT = {"gt": "lte", "gte": "lt", "lt": "gte", "lte": "gt"}


def compiled(filter_: Mapping, df: DataFrame, id_col: str = "point_id") -> Column:
    """The filter as a column of df."""
    return _compiled(filter_, df, id_col, True)


def _all(parts: Sequence[Column], empty: bool = True) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(empty)


def _any(parts: Sequence[Column], empty: bool = False) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(empty)


def _compiled(f: Mapping, df: DataFrame, id_col: str, holds: bool) -> Column:
    """Where f holds, or where it does not."""
    if not isinstance(f, Mapping):
        raise ValueError(f"a condition must be a mapping: {f!r}")
    words = set(f)
    if words <= set(_GROUPS):
        return _group(f, df, id_col, holds)
    if words == {"has_id"}:
        return _among(_field(df, id_col), _list(f["has_id"], "has_id"), holds)
    if words == {"is_null"}:
        key = _field(df, _word(f["is_null"], "key"))
        return key.isNull() if holds else key.isNotNull()
    if words == {"key", "match"}:
        return _match(_field(df, f["key"]), f["match"], holds)
    if words == {"key", "range"}:
        return _range(_field(df, f["key"]), f["range"], holds)
    raise ValueError(f"unknown words of a condition: {sorted(words)}")


def _group(f: Mapping, df: DataFrame, id_col: str, holds: bool) -> Column:
    each = {g: _list(f[g], g) for g in _GROUPS if f.get(g)}
    made = lambda g, wanted: [_compiled(c, df, id_col, wanted) for c in each.get(g, ())]
    if holds:
        return _all([*made("must", True), *([_any(made("should", True))] if "should" in each else []), *made("must_not", False)])
    return _any([*made("must", False), *([_all(made("should", False))] if "should" in each else []), *made("must_not", True)])


def _match(key: Column, match: Mapping, holds: bool) -> Column:
    word, value = _only(match, ("value", "any", "except", "text"))
    if word == "text":
        found = key.contains(str(value))
        return found if holds else ~found | key.isNull()
    values = [value] if word == "value" else _list(value, word)
    if word == "except":  # holds for known values that are not listed
        return _all([key.isNotNull(), *([~key.isin(values)] if values else [])]) if holds else _any([key.isNull(), *([key.isin(values)] if values else [])])
    return _among(key, values, holds)


def _among(key: Column, values: Sequence, holds: bool) -> Column:
    if not values:
        return F.lit(not holds)
    found = key == values[0] if len(values) == 1 else key.isin(list(values))
    return found if holds else ~found | key.isNull()


def _range(key: Column, limits: Mapping, holds: bool) -> Column:
    if not isinstance(limits, Mapping) or not set(limits) <= set(_RANGE):
        raise ValueError(f"a range has gt, gte, lt and lte: {limits!r}")
    given = {w: v for w, v in limits.items() if v is not None}
    if not given:
        return key.isNotNull() if holds else key.isNull()
    if holds:
        return _all([_RANGE[w](key, v) for w, v in given.items()])
    return _any([key.isNull(), *(_RANGE[_NOT[w]](key, v) for w, v in given.items())])


def _field(df: DataFrame, name: str) -> Column:
    if not isinstance(name, str) or name.split(".")[0] not in df.columns:
        raise ValueError(f"unknown key: {name!r}")
    return F.col(name)


def _word(m: Mapping, word: str):
    if not isinstance(m, Mapping) or set(m) != {word}:
        raise ValueError(f"{word} expected: {m!r}")
    return m[word]


def _only(m: Mapping, words: Sequence[str]) -> tuple[str, object]:
    if not isinstance(m, Mapping) or len(m) != 1 or not set(m) <= set(words):
        raise ValueError(f"one of {', '.join(words)} expected: {m!r}")
    return next(iter(m.items()))


def _list(value: object, word: str) -> list:
    if isinstance(value, (str, bytes, Mapping)) or not isinstance(value, Sequence):
        raise ValueError(f"{word} must be a list: {value!r}")
    return list(value)


def named(filter_: Mapping, key: str = "article_id") -> set | None:
    """The values that a filter leaves for a key, where it names them by must (also nested): None where it may be any."""
    sets = []
    for c in filter_.get("must") or ():
        if set(c) == {"key", "match"} and c["key"] == key and set(c["match"]) <= {"value", "any"}:
            sets.append(set(c["match"].get("any", [c["match"].get("value")])))
        elif set(c) <= set(_GROUPS) and (inner := named(c, key)) is not None:
            sets.append(inner)
    return set.intersection(*sets) if sets else None
