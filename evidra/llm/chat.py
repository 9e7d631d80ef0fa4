"""Chat formatting: messages of reply trees become one formatted conversation for each chosen path.

Only DataFrame operations run here. Root-to-leaf paths are enumerated by self-joins that double the stride at
each step, so a thread of n messages takes about log2(n) of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import checkpointed

# Fixed values of the template: what opens a turn, stands between role and text, and closes the turn.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
# Characters of control strings and what stands for them inside roles and texts.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("#", "&num;")]


def escaped(text: Column) -> Column:
    """``text`` without # and <, so that no control string can stand in it; ``unescaped`` gives it back."""
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), ESCAPES, text)


def escaped_role(role: Column) -> Column:
    """``escaped``, without colons as well, so that the first one in a turn ends its role."""
    return F.replace(escaped(role), F.lit(":"), F.lit("&col;"))


def unescaped(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), reversed(ESCAPES), text)


def threaded(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages (tree, message, parent, role, text, score) of flat conversations: each turn answers the one before.

    Turns go by number, null first, then role and text, so that ties have an order; rows that agree in all
    stay apart.
    """
    order = Window.partitionBy("tree").orderBy(F.col("nr").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("nr"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    return rows.select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(messages: DataFrame, paths_a_tree: int = 1) -> DataFrame:
    """(tree, path, depth, message) of the chosen root-to-leaf paths; ``path`` is the leaf's message.

    A message whose parent is null or not in its tree is a root. A path's score is the mean score of its
    messages (null counts 0); paths rank by score, then by number of messages, then by leaf, and the first
    ``paths_a_tree`` of each tree are chosen (each tree's leaves meet in partial maxima or one sort). Messages
    on a reply cycle reach no root and are left out.
    """
    nodes = messages.select("tree", "message", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("message").alias("m"))
    step = checkpointed(
        nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("m")), "left")
        .select("tree", "message", F.col("m").alias("up"), F.lit(1).cast("long").alias("n"), F.col("score").alias("sum"))
    )
    parents = step.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("m")).distinct()
    leaves = step.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")), "left_anti").select("tree", "message")
    strides, doubled, size = [step], step, None
    while True:
        left = doubled.where("up is not null").count()
        if not left or left == size:
            break
        size = left
        above = doubled.select(F.col("tree").alias("t"), F.col("message").alias("m"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("sum").alias("sum2"))
        on = doubled.where("up is not null").join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("m")))
        on = on.select("tree", "message", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("sum") + F.col("sum2")).alias("sum"))
        doubled = checkpointed(on.unionByName(doubled.where("up is null")))
        strides.append(doubled)
    ended = doubled.where("up is null").select(F.col("tree").alias("t"), F.col("message").alias("m"), "n", (F.col("sum") / F.col("n")).alias("mean"))
    scored = leaves.join(ended, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m"))).select("tree", "message", "n", "mean")
    if paths_a_tree == 1:
        best = scored.groupBy("tree").agg(F.max(F.struct("mean", "n", (-F.col("message")).alias("last"))).alias("b")).select("tree", (-F.col("b.last")).alias("path"), F.col("b.n").alias("depth"))
    else:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("n"), "message"))
        best = scored.withColumn("rank", rank).where(F.col("rank") <= paths_a_tree).select("tree", F.col("message").alias("path"), F.col("n").alias("depth"))
    reached = best.select("tree", "path", "depth", F.col("path").alias("message"))
    for k, jump in enumerate(strides[:-1] or strides[:0]):
        up = jump.where("up is not null").select(F.col("tree").alias("t"), F.col("message").alias("m"), "up")
        more = reached.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m"))).select("tree", "path", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("message"))
        reached = checkpointed(reached.unionByName(more))
    return reached


def format_paths(messages: DataFrame, paths_a_tree: int = 1) -> DataFrame:
    """One formatted conversation for each chosen path of ``messages`` (tree, message, parent, role, text, score).

    Returns tree, path, formatted and loss_spans: spans (start, end; code points, end exclusive) of the texts of
    assistant turns, in order. A turn is ``### role: text </turn>`` and a line end, with roles and texts
    escaped. Null roles and texts count as empty. A null tree is a tree. A conversation is one string and so is
    put together in one task; nothing else of its tree meets there. Empty input gives no rows.
    """
    content = messages.select(F.col("tree").alias("t"), F.col("message").alias("m"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = best_paths(messages, paths_a_tree).join(content, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")))
    head, body = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(MIDDLE)), escaped(F.col("text"))
    turns = turns.select("tree", "path", "depth", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("loss"))
    before = Window.partitionBy("tree", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.length("head") + F.length("body") + len(CLOSE)
    turns = turns.withColumn("start", (F.coalesce(F.sum(piece).over(before), F.lit(0)) + F.length("head")).cast("long"))
    turns = turns.select("tree", "path", F.struct("depth", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "start", (F.col("start") + F.length("body")).alias("end"), "loss").alias("x"))
    whole = turns.groupBy("tree", "path").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select(
        "tree", "path", F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("x", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.filter(F.split(formatted, F.lit(" </turn>\n"), F.lit(-1)), lambda x: x != "")
    middle = lambda x: F.instr(x, F.lit(MIDDLE))
    return F.transform(pieces, lambda x: F.struct(
        unescaped(F.replace(F.substring(x, F.lit(len(OPEN) + 1), middle(x) - len(OPEN) - 1), F.lit("&col;"), F.lit(":"))).alias("role"),
        unescaped(F.substring(x, middle(x) + len(MIDDLE), F.length(x))).alias("text"),
    ))


def under_mask(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss_spans, lambda x: unescaped(F.substring(formatted, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), "")
