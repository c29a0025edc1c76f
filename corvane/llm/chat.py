"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees by their parents. Iterative self-joins double the reach of each message: after k joins it knows its
ancestor 2^k steps up and the sum of scores on the way, so a tree of depth d takes log2(d) joins. Root-to-leaf paths are
ranked by the mean score of their messages; each chosen path is unfolded with the same jumps and formatted as one
conversation.

A turn is "### role: text</turn>" and a line feed. Control strings inside roles and texts are escaped: a backslash is
\\b, ### is \\h, </turn> is \\e and, in roles, a colon is \\c. So neither ### nor </turn> ever comes from a text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import cut

OPEN, CLOSE = "###", "</turn>"
_END = CLOSE + "\n"
MOST_JUMPS = 40  # depth 2^40


def escape(text: Column, role: bool = False) -> Column:
    text = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit(OPEN), F.lit("\\h")), F.lit(CLOSE), F.lit("\\e"))
    return F.replace(text, F.lit(":"), F.lit("\\c")) if role else text


def unescape(text: Column) -> Column:
    # every backslash in an escaped text is followed by one of b, h, e and c; the backslash itself must come last
    for code, plain in (("\\c", ":"), ("\\e", CLOSE), ("\\h", OPEN), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def linear_replies(turns: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text) as trees in which each turn replies to the one before.

    Rows of a conversation are ordered by turn (null first), then role and text; repeated rows are turns of their own.
    A null conv_id is a conversation of its own. Other columns are not read.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return rows.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def _ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jumps (tree, node, up) of 1, 2, 4 .. steps, and (tree, node, total, steps) summed from each node to its root.

    Nodes that have come to their root take no further part, so a few deep trees do not make all others go on.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    columns = ["tree", "node", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")]
    going = cut(nodes.join(known, ["tree", "parent"], "left_semi").withColumn("up", F.col("parent")).select(*columns))
    done = cut(nodes.join(known, ["tree", "parent"], "left_anti").withColumn("up", F.lit(None).cast("long")).select(*columns))
    jumps = []
    while not going.isEmpty():
        if len(jumps) == MOST_JUMPS:
            raise ValueError("the replies form a cycle")
        jumps.append(going.select("tree", "node", "up"))
        above = going.unionByName(done).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("steps").alias("s2"))
        total, steps = (F.col("total") + F.col("t2")).alias("total"), (F.col("steps") + F.col("s2")).alias("steps")
        step = cut(going.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), total, steps))
        going, done = step.where("up is not null"), done.unionByName(step.where("up is null"))
        if len(jumps) % 3 == 0:  # plans stay small on the driver
            done = cut(done)
    return jumps, done


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, branch_rank, branch_score, place, role, text) for the messages on the `best` paths of each tree.

    messages: tree, node (long, unique in its tree), parent (null or unknown for a root), role, text, score (null: 0).
    Paths are ranked by mean score, then fewer messages, then smaller leaf. place counts from 0 at the root.
    """
    # joins are on a key that is never null, so that a null tree is a tree
    trees = messages.select(
        F.concat(F.when(F.col("tree").isNull(), "-").otherwise("+"), F.coalesce(F.col("tree").cast("string"), F.lit(""))).alias("tree"),
        F.col("tree").alias("tree_id"), "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    nodes = trees.select("tree", "node", "parent", "score")
    jumps, total = _ancestors(nodes)
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node"))
    branch = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "steps", "leaf")
    chosen = (
        total.join(parents, ["tree", "node"], "left_anti")
        .select("tree", F.col("node").alias("leaf"), "steps", (F.col("total") / F.col("steps")).alias("branch_score"))
        .withColumn("branch_rank", F.row_number().over(branch))
        .where(F.col("branch_rank") <= best)
    )
    on = chosen.select("tree", "leaf", "branch_rank", "branch_score", F.col("leaf").alias("node"), (F.col("steps") - 1).alias("place"))
    # the largest jump first: then each step doubles the rows, and all steps together make twice the path
    for k, jump in reversed(list(enumerate(jumps))):
        both = F.array(F.struct("node", "place"), F.struct(F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place")))
        on = (
            on.join(jump, ["tree", "node"], "left")
            .withColumn("at", F.explode(F.filter(both, lambda x: x.node.isNotNull())))
            .select("tree", "leaf", "branch_rank", "branch_score", "at.node", "at.place")
        )
        if k and k % 4 == 0:
            on = cut(on)
    return on.join(trees.select("tree", "node", "tree_id", "role", "text"), ["tree", "node"]).select(
        F.col("tree").alias("_key"), F.col("tree_id").alias("tree"), "leaf", "branch_rank", "branch_score", "place", "role", "text"
    )


def format_paths(on_paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, branch_rank, branch_score, formatted, loss_spans) for each path; null roles and texts count as empty.

    loss_spans are the parts to learn from, as (start, bytes) in the UTF-8 bytes of `formatted`: the escaped texts of
    the role `learn`, in order. A conversation is one string, so it must fit in a row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN + " "), escape(role, True), F.lit(": "))
    turns = on_paths.select("_key", "tree", "leaf", "branch_rank", "branch_score", "place", (role == learn).alias("learn"), head.alias("head"), escape(text).alias("body"))
    size = F.octet_length("head") + F.octet_length("body") + len(_END)
    before = Window.partitionBy("_key", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.octet_length("head")
    return (
        turns.withColumn("start", start)
        .groupBy("_key", "leaf")
        .agg(
            F.first("tree").alias("tree"), F.first("branch_rank").alias("branch_rank"), F.first("branch_score").alias("branch_score"),
            F.sort_array(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(_END)).alias("turn"), "learn", "start", F.octet_length("body").alias("bytes")))).alias("turns"),
        )
        .select(
            "tree", "leaf", "branch_rank", "branch_score",
            F.array_join("turns.turn", "").alias("formatted"),
            F.transform(F.filter("turns", lambda t: t.learn), lambda t: F.struct(t.start.alias("start"), t.bytes.alias("bytes"))).alias("loss_spans"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn, from the formatted string alone."""
    turns = F.split(formatted, CLOSE + "\n")
    turns = F.slice(turns, 1, F.size(turns) - 1)
    head = lambda t: F.substring_index(t, ": ", 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring(head(t), F.lit(len(OPEN) + 2), F.length(t))).alias("role"),
            unescape(F.substring(t, F.length(head(t)) + 3, F.length(t))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped texts under the loss mask. Spans are in bytes, so that each is a plain slice."""
    data = formatted.cast("binary")
    return F.transform(loss_spans, lambda s: unescape(F.substring(data, s["start"].cast("int") + 1, s["bytes"]).cast("string")))
