"""Chat formatting of reply trees.

Root-to-leaf paths come of iterative self-joins that double their reach: round
k joins the paths found so far with the table of 2^k-th ancestors, so depth d
takes log2(d) rounds and the rows made are those of the paths. Branches are
ranked by score, and each chosen path becomes one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, text_of

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
ANSWERS = ("assistant",)


def escape(text: str) -> str:
    """``text`` without ``<|``, so that no mark of the template is in it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans its loss is taken over."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}{MIDDLE}", escape(text)
        if role in ANSWERS:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """What ``format_turns`` was given."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        middle = formatted.index(MIDDLE, at)
        end = formatted.index(END, middle)
        turns.append((unescape(formatted[at + len(START):middle]), unescape(formatted[middle + len(MIDDLE):end])))
        at = end + len(END)
    return turns


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) of ``nodes`` (tree, node, parent): every node on
    the path from a leaf to its root, ``up`` steps above the leaf. A parent that
    is null or not in the tree makes a root. Parents that form a ring raise a
    ValueError: a jump longer than there are nodes."""
    edges = nodes.select("tree", "node", "parent").filter("parent IS NOT NULL").join(
        nodes.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
    jump = materialize(edges.select("tree", "node", F.col("parent").alias("over")), "jump")
    inner = jump.select("tree", F.col("over").alias("node")).distinct()
    paths = materialize(nodes.join(inner, ["tree", "node"], "left_anti")
                        .select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    step, most = 1, nodes.count()
    while not jump.isEmpty():
        if step >= most:
            raise ValueError("parents form a ring")
        further = (paths.join(jump, ["tree", "node"])
                   .select("tree", "leaf", F.col("over").alias("node"), (F.col("up") + step).alias("up")))
        paths = materialize(paths.union(further), "paths")
        twice = jump.select("tree", F.col("node").alias("over"), F.col("over").alias("beyond"))
        jump = materialize(jump.join(twice, ["tree", "over"]).select("tree", "node", F.col("beyond").alias("over")), "jump")
        step *= 2
    return paths


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, turns) of the ``branches`` best leaves of each tree; turns
    is the path's (role, text) from the root. Best: the largest sum of ``score``
    over the path, then the smallest leaf. ``nodes``: tree, node, parent, role,
    text, score; (tree, node) is unique."""
    paths = leaf_paths(nodes)
    placed = paths.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    best = (placed.groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
            .withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
            .filter(F.col("rank") <= branches).select("tree", "leaf"))
    turns = paths.join(best, ["tree", "leaf"]).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    return turns.groupBy("tree", "leaf").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("place"), "role", "text"))),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, masks = [], []
        for turns in batch.column(1):
            text, spans = format_turns([(t["role"], t["text"]) for t in turns.as_py()])
            texts.append(text)
            masks.append([{"start": a, "end": b} for a, b in spans])
        mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(masks, mask)],
                              names=["tree", "formatted", "loss"])


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, formatted, loss spans) of each chosen path."""
    return map_arrow(chosen_paths(nodes, branches).select("tree", "turns"), _format,
                     "tree string, formatted string, loss array<struct<start: long, end: long>>")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2)):
            text = text.as_py()
            turns = read_turns(text)
            whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for role, said in turns:
                whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for span in spans.as_py():
                said = unescape(text[span["start"]:span["end"]])
                loss.update(said.encode("utf-8", "surrogatepass"))
                chars += len(said)
            rows.append((len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = zip(*rows) if rows else ((),) * 5
        yield pa.record_batch([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds))],
                              names=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, parsed from them alone."""
    return map_arrow(formatted.select("tree", "formatted", "loss"), _read,
                     "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def linear_trees(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turn tables as reply trees: each row answers the one before it.

    Ordered by turn (nulls first); of equal turns by role, then text, and
    repeated rows follow each other. Null roles and texts are empty. Rows with a
    null id are one conversation. Other columns are dropped.
    """
    clean = rows.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("tree"), F.col(turn_col).alias("turn"),
                        text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return materialize(
        clean.select("tree", place.alias("node"), "role", "text")
        .select("tree", "node", (F.col("node") - 1).alias("parent"), "role", "text",
                F.when(F.col("role").isin(*ANSWERS), F.char_length("text")).otherwise(0).cast("long").alias("score")), "turns")
