"""Context texts, prompts and answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.config import Generator
from lexispark.functions.text import truncate
from lexispark.package import ship


def passage(parent: str = "parent_text", article: str = "article_text") -> Column:
    """The parent's text, or where it is empty the article's."""
    return F.coalesce(F.when(F.col(parent) != "", F.col(parent)), F.col(article), F.lit(""))


def part(text: Column, number: str = "article_id") -> Column:
    """One source in the context: a fixed format."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(F.lit("Статья "), value(number), F.lit(" ("), value("codex"), F.lit("):\nНазвание: "), value("article_title"), F.lit("\nТекст: "), text, F.lit("\nРелевантность: "), F.format_string("%.4f", F.round("score", 4)), F.lit("\n"))


def contexts(hits: DataFrame, query_col: str = "query_id") -> DataFrame:
    """(query, context_text, relevant_articles): hits joined in the order of their ranks."""
    row = F.struct("rank", part(passage()).alias("part"), "article_id", "article_title", passage().alias("article_text"), "codex", "score")
    got = hits.groupBy(query_col).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    sources = F.transform("rows", lambda x: F.struct(*[x[c].alias(c) for c in ("article_id", "article_title", "article_text", "codex", "score")]))
    return got.select(query_col, F.array_join(F.transform("rows", lambda x: x["part"]), "\n---\n").alias("context_text"), sources.alias("relevant_articles"))


def user_prompt(query: Column, context: Column) -> Column:
    """A fixed text around the context and the question."""
    return F.concat(F.lit("Контекст (релевантные статьи законов):\n"), context, F.lit("\n\n---\n\nВопрос пользователя: "), query, F.lit("\n\nДай точный и структурированный ответ на основе предоставленного контекста."))


def messages(query: Column, context: Column, g: Generator = Generator()) -> Column:
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(one("system", F.lit(g.system_prompt)), one("user", user_prompt(query, context)))


def extractive(prompt: str) -> str:
    """A stand-in for a language model: the first source's whole text."""
    body = prompt.partition("\nТекст: ")[2]
    return body.partition("\nРелевантность:")[0]


def generate(asked: DataFrame, llm: Callable[[str], str] = extractive, query_col: str = "query_text") -> DataFrame:
    """asked with answer and answer_error; llm gets the user's prompt.

    Where the model raises, the answer is empty and answer_error says what it raised; where it returns None, the answer
    is empty too. Other rows are not affected.
    """

    ship(asked.sparkSession)

    @F.pandas_udf("answer string, answer_error string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        rows = []
        for p in prompts:
            try:
                rows.append((llm(p) or "", None))
            except Exception as e:  # any error of a foreign model is that row's own
                rows.append(("", f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["answer", "answer_error"])

    prompt = user_prompt(F.coalesce(F.col(query_col), F.lit("")), F.coalesce("context_text", F.lit("")))
    made = asked.withColumn("__made", run(prompt))
    return made.select(*asked.columns, F.col("__made.answer").alias("answer"), F.col("__made.answer_error").alias("answer_error"))


def chat(complete: Callable[..., str], g: Generator = Generator()) -> Callable[[str], str]:
    """A model for generate() from a chat function: complete(model=, messages=, max_tokens=, temperature=) -> text."""

    def ask(prompt: str) -> str:
        return complete(model=g.model, messages=[{"role": "system", "content": g.system_prompt}, {"role": "user", "content": prompt}], max_tokens=g.max_tokens, temperature=g.temperature)

    return ask


def score_percent(score: Column) -> Column:
    return F.format_string("%.1f", score * 100)


def clock(time: Column) -> Column:
    """A message's time of day, hours and minutes of two digits."""
    return F.date_format(time, "HH:mm")


def source_title(codex: Column, number: Column) -> Column:
    """A source's heading: a fixed format."""
    return F.concat(F.coalesce(codex, F.lit("")), F.lit(" - Статья "), number.cast("string"))


def query_generation_prompts(articles: DataFrame, template: str, most: int = 8000) -> DataFrame:
    """(article_id, prompt) for articles without a query; {text} is the text cut to `most` characters."""
    before, _, after = template.partition("{text}")
    return articles.where("query_text is null").select("article_id", F.concat(F.lit(before), truncate(F.col("article_text"), most), F.lit(after)).alias("prompt"))
