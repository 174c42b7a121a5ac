"""Chat formatting of reply trees.

A conversation is a tree: each message names the one it answers. Self-joins
that double the distance they reach (to the parent, its grandparent, four up,
...) give every message its depth and the score of its branch from the root, so
a tree of depth d takes log2(d) joins; joins along the same steps then list the
messages of the chosen root-to-leaf paths. Branches are ranked by score, then
depth, then first leaf; each chosen path becomes one formatted conversation.

The template writes a turn as ``<|role|>text<|end|>``. Inside texts and roles a
backslash, ``<`` and ``[``, with which control strings begin, become ``\\0``, ``\\1`` and
``\\2`` (in roles ``|`` becomes ``\\3``); so no control string can stand in a text and
``unescape`` gives every text back. The loss mask is a list of [begin, end)
code-point spans of the formatted string, one for each assistant text.

Only built-in functions run. All joins are on (conversation, message), which is
unique, so a large conversation spreads over tasks there. The turns of a conversation without a tree
are numbered in one sorted pass, and each chosen path becomes one string, in one task each.

Cases: null texts and roles count as empty; a message whose parent is null or
absent is a root; several roots are several trees of one conversation, ranked
together; null conversation ids form one conversation; repeated rows of a linear conversation
stay separate turns; messages on a cycle reach no root and are in no path; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, table

END = "<|end|>"
#: Doublings; paths of up to 2 ** MOST_STEPS messages.
MOST_STEPS = 40


def escape(text: Column) -> Column:
    for i, x in enumerate(("\\", "<", "[")):
        text = F.replace(text, F.lit(x), F.lit(f"\\{i}"))
    return text


def unescape(text: Column) -> Column:
    for x, i in (("|", 3), ("[", 2), ("<", 1), ("\\", 0)):
        text = F.replace(text, F.lit(f"\\{i}"), F.lit(x))
    return text


def linear_tree(turns: DataFrame) -> DataFrame:
    """Rows of ``turns`` (conv_id, turn, role, text) as messages that each answer the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select("conv_id", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def best_paths(tree: DataFrame, best: int = 1) -> DataFrame:
    """(conv_id, leaf, rank, depth, node): the messages of the ``best`` first branches of each conversation; depth counts from 0 at the root."""
    nodes = materialize(tree.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "chat-nodes")
    known = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    up = nodes.join(known, nodes["conv_id"].eqNullSafe(known["c"]) & (nodes["parent"] == known["n"]), "left").select("conv_id", "node", F.col("n").alias("up"), "score", F.col("n").isNotNull().cast("long").alias("depth"))
    up = materialize(up, "chat-up")
    # a message that has reached its root is done; only the others are joined further
    steps, ends = [up.filter("up is not null")], up.filter("up is null")
    while len(steps) <= MOST_STEPS and not steps[-1].isEmpty():
        near = steps[-1]
        far = near.unionByName(ends).select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("far_up"), F.col("score").alias("far_score"), F.col("depth").alias("far_depth"))
        joined = near.join(far, near["conv_id"].eqNullSafe(far["c"]) & (near["up"] == far["n"]), "left")
        further = joined.select("conv_id", "node", F.col("far_up").alias("up"), (F.col("score") + F.coalesce("far_score", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("far_depth", F.lit(0))).alias("depth"))
        further = materialize(further, "chat-up")
        reached = further.filter("up is null")
        if reached.isEmpty():
            break  # only cycles are left
        steps.append(further.filter("up is not null"))
        ends = ends.unionByName(reached)
    parents = nodes.select(F.col("conv_id").alias("c"), F.col("parent").alias("p")).filter("p is not null").distinct()
    leaves = ends.join(parents, ends["conv_id"].eqNullSafe(parents["c"]) & (ends["node"] == parents["p"]), "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("depth"), "node"))
    path = leaves.select("conv_id", F.col("node").alias("leaf"), rank.alias("rank"), "node").filter(F.col("rank") <= best)
    for step in steps:
        jump = step.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "up")
        above = path.join(jump, path["conv_id"].eqNullSafe(jump["c"]) & (path["node"] == jump["n"])).select("conv_id", "leaf", "rank", F.col("up").alias("node"))
        path = materialize(path.unionByName(above), "chat-paths")
    depth = ends.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "depth")
    return path.join(depth, path["conv_id"].eqNullSafe(depth["c"]) & (path["node"] == depth["n"])).select("conv_id", "leaf", "rank", "depth", "node")


def format_paths(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss_spans): one row for each path."""
    said = tree.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, paths["conv_id"].eqNullSafe(said["c"]) & (paths["node"] == said["n"]))
    head = F.concat(F.lit("<|"), F.replace(escape(F.col("role")), F.lit("|"), F.lit("\\3")), F.lit("|>"))
    turns = turns.select("conv_id", "leaf", "rank", "depth", (F.col("role") == "assistant").alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("segment", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("segment").cast("long")).over(order) - len(END)
    turns = turns.withColumn("end", end)
    spans = F.when(F.col("loss"), F.struct((F.col("end") - F.length("body")).alias("begin"), F.col("end")))
    rows = turns.select("conv_id", "leaf", "rank", "depth", "segment", spans.alias("span")).groupBy("conv_id", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "segment", "span"))).alias("t"))
    return rows.select("conv_id", "leaf", "rank", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"), F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    segments = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")

    def turn(x):
        head = F.substring_index(x, "|>", 1)
        return F.struct(unescape(F.substring(head, 3, F.length(head))).alias("role"), unescape(F.substring(x, F.length(head) + 3, F.length(x))).alias("text"))

    return F.transform(segments, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, as one string."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    tree = materialize(linear_tree(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)), "chat-tree")
    done = format_paths(tree, best_paths(tree))
    read = done.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + length(regexp_replace(role, '[^\\<\[|]', '', 'g')) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + 11)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
