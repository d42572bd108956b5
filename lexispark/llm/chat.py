"""Reply trees to chat strings.

A tree's nodes know their parent. paths() walks from every leaf to its root by self-joins that double the stride:
the table of ancestors 2^k steps up joins itself to give 2^(k+1), and joined to the steps found so far it doubles
them, so a path of n nodes takes log2(n) rounds and never more rows than all paths have together. Branches rank
by score, and each chosen path becomes one formatted string with a loss mask over the assistant's texts.

The template: `<|im_start|>role\\ntext<|im_end|>\\n` per turn. Control strings inside roles and texts (those of the
template, and the marks of other common templates) are broken up by a backslash, backslashes are doubled, and
parse() undoes both.

Defined results: null texts and roles are empty; repeated rows are turns of their own; ties of turn are ordered by
role, then text; nodes whose parent is missing are roots; nodes on a cycle have no leaf and give no path; a null tree is
a tree like others; branches of equal score rank by the smaller leaf; a conversation of any length is one string; an
empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import prepare, saved

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\]|/?SYS\])|<(?=<SYS>>|</SYS>>)")
_ESCAPED = re.compile(r"\\(\\|n)?")


def escape(text: str) -> str:
    """text without control strings: backslashes doubled, a backslash after the first character of each control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "\n" if m[1] == "n" else "", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted string, and where the assistant's texts begin and end in it."""
    parts, begins, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role).replace("\n", "\\n") + "\n", escape(text)
        if role == "assistant":
            begins.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), begins, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, body = part.partition("\n")
        if not body.endswith(CLOSE):
            raise ValueError("a turn is not closed")
        out.append((unescape(role), unescape(body[: -len(CLOSE)])))
    return out


def chain(df: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes of linear conversations: each turn answers the one before it."""
    rows = df.select(F.col(tree_col).alias("tree"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("bigint")
    return rows.select("tree", place.alias("node"), F.when(place > 1, place - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node of every root-to-leaf path, `up` steps above the leaf.

    nodes: tree, node, parent, unique by (tree, node). Joins treat null trees as equal.
    """
    spark = nodes.sparkSession
    tree_of = lambda a, b: a["tree"].eqNullSafe(b["tree"])
    links = nodes.select("tree", "node", "parent")
    inner = links.where("parent is not null").alias("c").join(links.select("tree", "node").alias("p"), F.col("c.tree").eqNullSafe(F.col("p.tree")) & (F.col("c.parent") == F.col("p.node")))
    jump = saved(inner.select("c.tree", "c.node", F.col("c.parent").alias("up_node")), "chat-jump")
    parents = jump.select("tree", F.col("up_node").alias("node"))
    leaves = links.select("tree", "node").alias("n").join(parents.alias("q"), F.col("n.tree").eqNullSafe(F.col("q.tree")) & (F.col("n.node") == F.col("q.node")), "left_anti")
    found = saved(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up")), "chat-paths")
    stride, most = 1, nodes.count()
    while stride <= most:  # a longer stride than there are nodes: only cycles are left
        a, j = found.alias("a"), jump.alias("j")
        step = a.join(j, F.col("a.tree").eqNullSafe(F.col("j.tree")) & (F.col("a.node") == F.col("j.node"))).select("a.tree", "a.leaf", F.col("j.up_node").alias("node"), (F.col("a.up") + stride).alias("up"))
        found = saved(found.unionByName(step), "chat-paths")
        b, c = jump.alias("b"), jump.alias("c")
        jump = saved(b.join(c, F.col("b.tree").eqNullSafe(F.col("c.tree")) & (F.col("b.up_node") == F.col("c.node"))).select("b.tree", "b.node", F.col("c.up_node").alias("up_node")), "chat-jump")
        stride *= 2
        if jump.isEmpty():
            break
    return found


def branches(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, branch_score, turns array<struct<role, text>>) of the best `keep` branches of each tree.

    A branch's score is the mean of its nodes' scores (null: 0); ties go to the smaller leaf.
    """
    found = paths(nodes)
    scored = nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score"), "role", "text")
    joined = found.alias("f").join(scored.select("tree", "node", "score").alias("s"), F.col("f.tree").eqNullSafe(F.col("s.tree")) & (F.col("f.node") == F.col("s.node")))
    means = joined.groupBy("f.tree", "f.leaf").agg(F.avg("s.score").alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    chosen = means.withColumn("rank", rank).where(F.col("rank") <= keep)
    steps = found.alias("f").join(chosen.alias("c"), F.col("f.tree").eqNullSafe(F.col("c.tree")) & (F.col("f.leaf") == F.col("c.leaf"))).select("f.tree", "f.leaf", "f.node", "f.up", "c.rank", "c.branch_score")
    full = steps.alias("p").join(scored.alias("s"), F.col("p.tree").eqNullSafe(F.col("s.tree")) & (F.col("p.node") == F.col("s.node"))).select("p.tree", "p.leaf", "p.rank", "p.branch_score", F.struct((-F.col("p.up")).alias("place"), "s.role", "s.text").alias("turn"))
    turns = F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return full.groupBy("tree", "leaf", "rank", "branch_score").agg(turns.alias("turns"))


def formatted(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_begin, loss_end): one string for each chosen branch; loss spans in code points."""
    prepare(nodes.sparkSession)
    source = branches(nodes, keep).select("tree", "leaf", "rank", "turns")
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in ("tree", "leaf", "rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turns([(t["role"], t["text"]) for t in x]) for x in b.column(3).to_pylist()]
            texts, begins, ends = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(texts, pa.string()), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["tree", "leaf", "rank", "formatted", "loss_begin", "loss_end"])

    return source.mapInArrow(run, f"{kinds}, formatted string, loss_begin array<bigint>, loss_end array<bigint>")


def digests(strings: DataFrame) -> DataFrame:
    """What can be read back from formatted(): turns, and the text under the loss mask."""
    source = strings.select("tree", "formatted", "loss_begin", "loss_end")
    kind = source.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, begins, ends in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                turns = parse(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(begins, ends))
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return source.mapInArrow(run, f"tree {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
