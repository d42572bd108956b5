"""Scans and sinks over files of this test."""

import pytest
from pyspark.sql import functions as F

from lexispark.operators import prepare
from lexispark.operators.sparse import token_ids
from lexispark.sources import files


@pytest.mark.parametrize(
    "raw, text",
    [
        (r"{\rtf1\ansi{\fonttbl{\f0 Times New Roman;}{\f1 Arial;}}\f0 plain}", "plain"),
        (r"{\rtf1\ansi\ansicpg1251 \'d1\'f2\'e0\'f2\'fc\'ff 1\par \'e0}", "Статья 1\nа"),
        ("{\\rtf1 \\u1057?\\u1090\\'3f\\u1072 ?b}", "Стаb"),
        ("{\\rtf1\\uc2 \\u1057??x\\uc0\\u1058 y}", "СxТy"),
        ("{\\rtf1 a\\u-10179?\\u-8704?b\\u-10179?}", "a\U0001f600b"),
        (r"{\rtf1{\stylesheet{\s0 Normal;}}{\*\generator Word;}{\info{\title secret}}a\tab b\line c\~d}", "a\tb\nc d"),
        ("{\\rtf1 x {\\b bold} \\{y\\}\\\\ z\r\nq}", "x bold {y}\\ zq"),
        (r"{\rtf1 {\unknown a} \emdash  b\row c}", "a — b\nc"),
        (r"{\rtf1 unbalanced } } text", "unbalanced text"),
        (r"{\rtf1}", ""),
    ],
)
def test_rtf_text(raw, text):
    assert files.rtf_plain(raw) == text


def test_rtf_folder(spark, tmp_path):
    (tmp_path / "N 63 a+b.rtf").write_bytes(b"{\\rtf1\\ansi good \xff\xd0\xa1\\par two}")
    (tmp_path / "bad.rtf").write_bytes(b"no rtf")
    (tmp_path / "empty.rtf").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"{\\rtf1 other}")
    got = files.read_rtf(spark, str(tmp_path))
    assert {r["name"]: (r["text"], r["_error"]) for r in got.collect()} == {"N 63 a+b.rtf": ("good С\ntwo", None), "bad.rtf": (None, "not an RTF file")}
    assert tuple(files.scan_counts(got).first()) == (2, 1, 1)


def test_csv_keeps_texts(spark, tmp_path):
    rows = [("1", 'a "quoted", line\nand  another ', "x"), ("2.1", "", None), ("3", None, " y ")]
    df = spark.createDataFrame(rows, "`Номер статьи` string, `Текст статьи` string, `Запрос` string")
    files.write_csv(df, f"{tmp_path}/c")
    part = next(p for p in (tmp_path / "c").iterdir() if p.suffix == ".csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    back = files.read_raw_articles(spark, f"{tmp_path}/c")
    assert back.columns == ["article_num", "article_text", "query_text"]
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted([rows[0], ("2.1", None, None), rows[2]], key=str)
    files.write_csv(df, f"{tmp_path}/plain", mark=False)
    assert files.read_csv(spark, f"{tmp_path}/plain").columns == df.columns


@pytest.mark.parametrize("name", ["v.json", "v.parquet"])
def test_vocabularies_continue(spark, tmp_path, name):
    known = spark.createDataFrame([("закон", 0)], "token string, token_id bigint")
    files.write_vocabulary(known, f"{tmp_path}/{name}")
    back = files.read_vocabulary(spark, f"{tmp_path}/{name}")
    post = spark.createDataFrame([("закон",), ("б",), ("в",), ("б",)], "token string")
    got = {r["token"]: r["token_id"] for r in token_ids(post, back).collect()}
    assert got["закон"] == 0 and sorted(got.values()) == [0, 1, 2]
    assert sorted(r["token_id"] for r in token_ids(post).collect()) == [0, 1, 2]
    assert token_ids(post.where("false")).count() == 0


def articles_of(spark, text):
    got = prepare.split_articles(spark.createDataFrame([("f", text)], "name string, text string")).orderBy("pos").collect()
    return [(r["article_num"], r["article_title"], r["article_text"]) for r in got]


LONG = "т" * 60


@pytest.mark.parametrize(
    "text, want",
    [
        # one line, with and without a newline at the file's end
        (f"Статья 1 {LONG}\n", [("1", "", LONG)]),
        (f"Статья 1 {LONG}", [("1", "", LONG)]),
        # the title is the first line, also after a heading that goes and a blank line
        (f"Статья 2. Имя  статьи \n{LONG}", [("2", "Имя статьи", LONG)]),
        (f"Статья 3\nГлава 1. Общее\n\nИмя\n{LONG}", [("3", "Имя", LONG)]),
        # what stands before the first numbered point is the title, over several lines
        (f"Статья 4. Имя\nв строках\n 1. {LONG}\n2. Далее", [("4", "Имя в строках", f"1. {LONG}\n2. Далее")]),
        # a sentence, with the next one's first letter; a line of 200 characters is no title
        (f"Статья 5 Короткое имя. {LONG.capitalize()}", [("5", "Короткое имя. Т", LONG[1:])]),
        (f"Статья 6 {'а' * 200}\nбб", [("6", "", f"{'а' * 200}\nбб")]),
        # blank lines within go; short bodies and headings go
        (f"Статья 7\nИмя\n{LONG}\n \n\n{LONG}", [("7", "Имя", f"{LONG}\n{LONG}")]),
        (f"Статья 8\nмало\nстатья 9.1\nИмя\nГЛАВА 3 {LONG}", []),
        (f"вступление\r\nСТАТЬЯ 10: Имя\r{LONG}", [("10", "Имя", LONG)]),
        (None, []),
    ],
)
def test_titles_and_bodies(spark, text, want):
    assert articles_of(spark, text) == want


def test_required_columns_and_order(spark):
    df = spark.createDataFrame([("b", "2.1"), ("a", "10"), ("a", "9"), ("a", None)], "codex string, article_num string")
    with pytest.raises(ValueError, match="missing columns: x, y"):
        prepare.require_columns(df, ["codex", "x", "y"])
    assert [tuple(r) for r in prepare.sort_articles(df, ["article_num"]).collect()] == [("a", None), ("a", "9"), ("a", "10"), ("b", "2.1")]
    assert prepare.any_null(df).count() == 1


@pytest.mark.parametrize("how", ["same_codex", "random", "in_batch"])
def test_negatives(spark, how):
    a = spark.range(60).select(F.col("id").alias("article_id"), (F.col("id") % 3).cast("string").alias("codex"))
    mine = a.where("article_id < 30").select(F.col("article_id").alias("query_id"), "article_id")
    got = prepare.negatives(mine, a, 4, how=how, ring=20).collect()
    assert len(got) == 120 and len({tuple(r) for r in got}) == 120
    assert all(r["negative_id"] != r["article_id"] for r in got)
    if how == "same_codex":
        assert all((r["negative_id"] - r["article_id"]) % 3 == 0 for r in got)
    if how == "in_batch":
        assert all(r["negative_id"] < 30 for r in got)


def test_unknown_negatives(spark):
    with pytest.raises(ValueError):
        prepare.negatives(None, None, how="other")


def test_split_keys_of_large_ids(spark):
    df = spark.createDataFrame([(2**62,), (-(2**62),), (None,)], "id bigint")
    assert [r["k"] for r in df.select(prepare.split_key("id").alias("k")).collect() if r["k"] is not None] == [((x % 10007) * 7919 + 42 * 104729) % 10007 for x in (2**62, -(2**62))]
