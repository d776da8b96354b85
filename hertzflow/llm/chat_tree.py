"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share these. Every distinct beginning is a
node; nodes are laid out depth-first in one sequence of characters, each once, with
position ids that go on from the parent and the intervals of the sequence that a node
may attend to: its ancestors and itself.

A beginning is named by sums of turn hashes along the conversation, which the levelled
prefix scan of the library takes over chunks of rows, so a conversation that holds a third
of all turns is not one task. Depth-first order needs no walk: conversations are ordered
by their choices where the tree branches, and a node stands with the first conversation
that reaches it. Counts are pre-aggregated; joins on a node that very many conversations
share have one row on the other side and can be split by AQE. Nothing is broadcast.

Template: ``<s>[role] text</s>`` per turn. In roles and texts the characters ``\\ < [ ]``
get a backslash before them, so no text can hold a control string, and reading takes it
away again. The loss mask covers the texts of ``loss_role``.

Null roles and texts are empty. Turns are ordered by number, then role, then text, so
repeated turns both count. Rows without a conv_id are one conversation, returned with a
null id. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.layout import order_rows, series_row_number
from ..storage import stage

_SPECIAL = r"([\\<\[\]])"
_NO_ID = -(1 << 63)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + _SPECIAL, "$1")


@dataclass(frozen=True)
class ChatTree:
    """``sequence``: node, parent (null for first turns), run, depth, start, stop (its place in the
    sequence), position (id of its first character), text (formatted), loss_start, loss_stop
    (null without loss), ancestors (intervals of the sequence it attends to besides itself).
    ``paths``: conv_id, n_turns and spans (run, start, stop), the intervals that make up a
    conversation."""

    sequence: DataFrame
    paths: DataFrame


def format_chats(
    chats: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> ChatTree:
    head = F.concat(F.lit("<s>["), escaped(F.col("role")), F.lit("] "))
    rows = chats.select(
        F.coalesce(F.col(conv_id).cast("bigint"), F.lit(_NO_ID)).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ordered = series_row_number(order_rows(rows, ["conv"], ["turn", "role", "text"]), "depth")
    body = escaped(F.col("text"))
    each = ordered.df.select(
        "conv",
        "depth",
        "_pos",
        F.concat(head, body, F.lit("</s>")).alias("formatted"),
        F.length(head).alias("head"),
        F.length(body).alias("body"),
        (F.col("role") == loss_role).alias("has_loss"),
        *(F.xxhash64(F.lit(seed), "depth", "role", "text").cast("decimal(20,0)").alias(f"h{seed}") for seed in (1, 2)),
    )
    each = each.withColumn("size", F.length("formatted").cast("bigint"))
    each = stage(each, "turns")
    sums = ordered.with_df(each).running(
        {"p1": ("sum", F.col("h1")), "p2": ("sum", F.col("h2")), "upto": ("sum", F.col("size"))}
    )
    node = F.xxhash64("depth", "p1", "p2")
    parent = F.when(F.col("depth") > 1, F.xxhash64(F.col("depth") - 1, F.col("p1") - F.col("h1"), F.col("p2") - F.col("h2")))
    steps = sums.withColumns({"node": node, "parent": parent, "position": F.col("upto") - F.col("size")})
    steps = stage(steps.drop("h1", "h2", "p1", "p2", "upto", "_pos"), "steps")

    # Where a tree branches, the choice tells conversations apart; first turns always do.
    edges = steps.select("node", "parent", "depth").distinct()
    forks = edges.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    chosen = edges.where("depth = 1").select("node").union(edges.join(forks, "parent").select("node"))
    choices = steps.select("conv", "depth", "node").join(chosen, "node")
    keys = choices.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]).alias("key"))
    ranked = order_rows(keys, [], ["key", "conv"]).df.select("conv", F.col("_pos").alias("rank"))

    placed = stage(steps.select("conv", "depth", "node").join(ranked, "conv"), "ranked-steps")
    first = placed.groupBy("node").agg(F.min("rank").alias("run"))
    owners = placed.join(first, "node").where("rank = run").select("conv", "depth", "run")
    nodes = steps.join(owners, ["conv", "depth"])
    laid = order_rows(nodes.drop("conv"), [], ["run", "depth"])
    sequence = stage(laid.running({"stop": ("sum", F.col("size"))}), "sequence")
    sequence = sequence.withColumn("start", F.col("stop") - F.col("size"))

    # A conversation is a few intervals: the nodes that it reaches of each run.
    places = sequence.select("node", "run", "start", "stop")
    reached = placed.select("conv", "rank", "node").join(places, "node")
    spans = reached.groupBy("conv", "rank", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")
    )
    spans = spans.groupBy("conv", "rank").agg(
        F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("start", "stop", "run"))).alias("spans")
    )
    spans = stage(spans, "paths")
    own = F.filter("spans", lambda s: s["run"] == F.col("rank"))
    inherited = F.transform(F.filter("spans", lambda s: s["run"] != F.col("rank")), lambda s: F.struct(s["start"], s["stop"]))
    runs = spans.where(F.size(own) > 0).select(F.col("rank").alias("run"), own[0]["start"].alias("begin"), inherited.alias("above"))
    here = F.when(F.col("start") > F.col("begin"), F.array(F.struct(F.col("begin").alias("start"), F.col("start").alias("stop"))))
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    loss = F.when(F.col("has_loss"), F.col("start") + F.col("head"))
    sequence = sequence.join(runs, "run").select(
        "node",
        "parent",
        "run",
        "depth",
        "start",
        "stop",
        "position",
        F.col("formatted").alias("text"),
        loss.alias("loss_start"),
        (loss + F.col("body")).alias("loss_stop"),
        F.concat("above", F.coalesce(here, none)).alias("ancestors"),
    )
    whole = F.nullif("conv", F.lit(_NO_ID)).alias("conv_id")
    return ChatTree(sequence, spans.select(whole, "n_turns", "spans"))


def read_back(tree: ChatTree) -> DataFrame:
    """The turns, from the output alone: conv_id, depth, role, text, loss (the masked text, unescaped;
    null without loss) and size (formatted characters)."""
    spans = tree.paths.select(F.coalesce("conv_id", F.lit(_NO_ID)).alias("conv"), F.explode("spans").alias("span"))
    spans = spans.select("conv", F.col("span.run").alias("run"), F.col("span.start").alias("from"), F.col("span.stop").alias("to"))
    parts = tree.sequence.select("run", "depth", "start", "stop", "text", "loss_start", "loss_stop")
    rows = parts.join(spans, "run").where("start >= from AND stop <= to")
    # Possessive: a match that keeps no way back needs no stack per character.
    pattern = r"(?s)^<s>\[((?:[^\\\]]|\\.)*+)\] (.*)</s>$"
    masked = F.substring("text", (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int"))
    return rows.select(
        F.nullif("conv", F.lit(_NO_ID)).alias("conv_id"),
        "depth",
        unescaped(F.regexp_extract("text", pattern, 1)).alias("role"),
        unescaped(F.regexp_extract("text", pattern, 2)).alias("text"),
        unescaped(masked).alias("loss"),
        (F.col("stop") - F.col("start")).alias("size"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of ``read_back``: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns stream through the task of their conversation, which holds hash states only.
    """

    def rows(batches):
        now, state = object(), None

        def done():
            n, whole, loss_chars, loss, size = state
            return [(now, n, whole.hexdigest(), loss_chars, loss.hexdigest(), size)]

        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for pdf in batches:
            out = []
            for conv, role, text, loss, size in pdf[["conv_id", "role", "text", "loss", "size"]].itertuples(index=False):
                conv = conv if isinstance(conv, str) else None
                if state is None or conv != now:
                    if state is not None:
                        out += done()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if isinstance(loss, str):
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += int(size)
            yield pd.DataFrame(out, columns=columns)
        if state is not None:
            yield pd.DataFrame(done(), columns=columns)

    # Ids travel as text: pandas would turn a batch's integers into floats beside a null.
    schema = "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    named = turns.withColumn("conv_id", F.col("conv_id").cast("string"))
    found = named.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInPandas(rows, schema)
    return found.withColumn("conv_id", F.col("conv_id").cast("bigint"))
