"""Reply trees to training conversations, in DataFrame operations only.

Iterated self-joins double the distance over which each message knows its ancestor, and
sum the scores passed, until every leaf knows its root; branches are ranked by score, the
same jumps enumerate the messages of each chosen path, and these are formatted as one
conversation with the spans of its loss mask.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._staging import stage

TURN, END = "<|turn|>", "<|end|>\n"


def escape(text: Column) -> Column:
    """Texts without control strings: no < or [ is left, and & only begins one of the stand-ins."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def _leaves(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, leaf, score, n) for each leaf with a root, n the messages of its path; and the jumps (tree, id, up) over 1, 2, 4, ... replies.

    Each doubling joins only messages that have not reached their root yet, with the trees
    that still hold such messages. Messages on a cycle never reach one: when a doubling
    leaves as many open messages as before, only those are left.
    """
    ids = messages.select("tree", F.col("id").alias("parent")).distinct()
    known = messages.join(ids.withColumn("has", F.lit(True)), ["tree", "parent"], "left")
    nodes = stage(known.select("tree", "id", F.when(F.col("has"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("total")))
    parents = nodes.where("up is not null").select("tree", F.col("up").alias("id")).distinct().withColumn("inner", F.lit(True))
    state = nodes.join(parents, ["tree", "id"], "left").select("tree", "id", "up", "total", F.lit(1).cast("long").alias("n"), F.col("inner").isNull().alias("leaf"))
    state = stage(state)
    ended, jumps, before = [], [], None
    while True:
        ended.append(state.where("leaf and up is null"))
        unfinished = state.where("up is not null")
        count = unfinished.count()
        if count in (0, before):
            break
        before = count
        jumps.append(unfinished.select("tree", "id", "up"))
        above = state.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("plus"), F.col("n").alias("more"))
        moved = unfinished.join(above, ["tree", "up"]).select("tree", "id", F.col("next").alias("up"), (F.col("total") + F.col("plus")).alias("total"), (F.col("n") + F.col("more")).alias("n"), "leaf")
        finished = state.where("up is null").join(unfinished.select("tree").distinct(), "tree", "left_semi").withColumn("leaf", F.lit(False))
        state = stage(moved.unionByName(finished))
    found = reduce(DataFrame.unionByName, ended)
    return found.select("tree", F.col("id").alias("leaf"), (F.col("total") / F.col("n")).alias("score"), "n"), jumps


def _paths(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, n, id, back) for every message between root and leaf, back counting from the leaf.

    Each distance from the leaf is one sum of powers of two, so every message is reached
    once and the rows made are those returned.
    """
    reached = [stage(leaves.select("tree", "leaf", "n", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("back")))]
    for k in range(len(jumps) - 1, -1, -1):
        able = reduce(DataFrame.unionByName, [r.where(F.col("n") - F.col("back") > 2**k) for r in reached])
        reached.append(stage(able.join(jumps[k], ["tree", "id"]).select("tree", "leaf", "n", F.col("up").alias("id"), (F.col("back") + 2**k).alias("back"))))
    return reduce(DataFrame.unionByName, reached)


def branches(messages: DataFrame) -> DataFrame:
    """(tree, leaf, path, score): for each leaf the messages from the root to it, and the mean of their scores.

    ``messages`` has tree (never null), id (unique in its tree), parent (null for a root)
    and score. A message whose parent is missing begins a tree of its own; messages on a
    cycle belong to no path.
    """
    leaves, jumps = _leaves(messages)
    steps = _paths(leaves, jumps).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "id"))).alias("steps"))
    return leaves.join(steps, ["tree", "leaf"]).select("tree", "leaf", F.col("steps.id").alias("path"), "score")


def format_branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best branches of each reply tree, each formatted as one conversation.

    ``messages``: tree, id, parent, role, text, score. Returns tree, leaf, rank (from 1; ties
    go to the smaller leaf), score, n_turns, formatted, and loss: the spans (start from 0,
    length, in code points) of what assistants said. Null texts and roles count as empty;
    other columns are ignored; an empty table gives an empty result.
    """
    leaves, jumps = _leaves(messages)
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    chosen = stage(leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
    steps = _paths(chosen, jumps).withColumn("at", F.col("n") - F.col("back"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = messages.select("tree", "id", (role == "assistant").alias("trained"), F.concat(F.lit(TURN), _escape_role(role), F.lit("\n")).alias("head"), escape(text).alias("body"))
    turns = steps.join(said, ["tree", "id"])
    so_far = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    start = F.coalesce(F.sum(size).over(so_far), F.lit(0)) + F.length("head")
    span = F.when(F.col("trained"), F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    pieces = turns.select("tree", "leaf", F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span")).alias("turn"))
    whole = pieces.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns")).join(chosen, ["tree", "leaf"])
    return whole.select(
        "tree", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    marked = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substr(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(marked, turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Rows of conversations as messages, each the reply to the row before it by turn.

    Rows of the same turn follow by role and text; a null conv_id is a conversation of its own.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
