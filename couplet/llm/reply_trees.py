"""Reply trees as conversations: root-to-leaf paths, ranked by score, formatted with a loss mask.

A message names its parent. Self-joins double the reach of every message's ancestor pointer, so a
path of length n takes log2(n) rounds; they give each message its root, its depth and the score of
its path. The leaves of a tree are ranked by path score, and the chosen paths are walked back with
the same pointers, one row per message on a path.

Nulls and edges: a null text or role is empty, a null score counts 0. A parent that does not exist
makes its child a root. Messages on a cycle have no root and are on no path. Ties rank by the
smaller leaf id. Rows without a node id are left out; a null tree id is a tree of its own. Rows that
repeat a node of a tree count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from couplet.operators.shared import materialise

START, END, TURN_END = "<s>", "</s>", "<|end|>\n"
_MARKED = r"([\\<\[|])"        # the characters that control strings begin with, and the escape itself


def escape(text: Column) -> Column:
    """Put a backslash after every character that could begin a control string; reversible."""
    return F.regexp_replace(text, _MARKED, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _MARKED + r"\\", "$1")


def paths(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent",
          score: str = "score", top: int = 1) -> DataFrame:
    """``(tree, path_rank, path_score, depth, node)``: the messages of the ``top`` best paths per tree.

    The score of a path is the sum of its messages' scores; ``path_rank`` starts at 1.
    """
    same = lambda a, b: a["tree"].eqNullSafe(b["tree"])
    plain = messages.where(F.col(f"`{node}`").isNotNull()).select(
        F.col(f"`{tree}`").alias("tree"), F.col(f"`{node}`").alias("node"), F.col(f"`{parent}`").alias("parent"),
        F.coalesce(F.col(f"`{score}`").cast("double"), F.lit(0.0)).alias("score"))
    nodes = plain.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.min("score").alias("score"))
    nodes = materialise(nodes)
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    level = materialise(nodes.join(known, nodes["tree"].eqNullSafe(known["t"]) & (nodes["parent"] == known["p"]), "left")
                        .select("tree", "node", F.col("p").alias("up"), "score", F.lit(1).cast("long").alias("depth")))
    n = nodes.count()
    jumps, reach = [level.where("up is not null").select("tree", "node", "up")], 1
    parents = jumps[0]
    # Only messages whose pointer has not passed the root are joined again.
    done, live = level.where("up is null"), level.where("up is not null")
    while reach <= n and live.limit(1).count():
        above = done.unionByName(live).select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"),
            F.col("score").alias("more"), F.col("depth").alias("steps"))
        level = materialise(live.join(above, live["tree"].eqNullSafe(above["t"]) & (live["up"] == above["n"]))
                            .select("tree", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"),
                                    (F.col("depth") + F.col("steps")).alias("depth")))
        done, live = done.unionByName(level.where("up is null")), level.where("up is not null")
        jumps.append(live.select("tree", "node", "up"))
        reach *= 2
    rooted = done
    inner = parents.select(F.col("tree").alias("t"), F.col("up").alias("u")).distinct()
    leaves = rooted.join(inner, rooted["tree"].eqNullSafe(inner["t"]) & (rooted["node"] == inner["u"]), "left_anti")
    if top == 1:
        best = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("score")).alias("s"), "node", "depth")).alias("b")) \
            .select("tree", F.lit(1).alias("path_rank"), (-F.col("b.s")).alias("path_score"), F.col("b.depth").alias("depth"),
                    F.col("b.node").alias("node"))
    else:
        order = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
        best = leaves.withColumn("path_rank", F.row_number().over(order)).where(F.col("path_rank") <= top) \
            .select("tree", "path_rank", F.col("score").alias("path_score"), "depth", "node")
    walked = materialise(best)
    for k in range(len(jumps) - 1, -1, -1):
        jump = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        further = walked.join(jump, walked["tree"].eqNullSafe(jump["t"]) & (walked["node"] == jump["n"])) \
            .select("tree", "path_rank", "path_score", (F.col("depth") - F.lit(1 << k)).alias("depth"),
                    F.col("up").alias("node"))
        walked = materialise(walked.unionByName(further))
    return walked


def formatted(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent",
              score: str = "score", role: str = "role", text: str = "text", top: int = 1,
              learned: str = "assistant") -> DataFrame:
    """``(tree, path_rank, path_score, formatted, loss_spans)``, one row per chosen path.

    A conversation is ``<s>``, then per turn ``<|role|>``, a line break, the escaped text and
    ``<|end|>``, then ``</s>``. ``loss_spans`` holds start and end (code points of ``formatted``)
    of the texts of the ``learned`` role.
    """
    chosen = paths(messages, tree, node, parent, score, top)
    body = messages.select(F.col(f"`{tree}`").alias("t"), F.col(f"`{node}`").alias("n"),
                           F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                           F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).dropDuplicates(["t", "n"])
    said = chosen.join(body, chosen["tree"].eqNullSafe(body["t"]) & (chosen["node"] == body["n"])) \
        .select("tree", "path_rank", "path_score", "depth", (F.col("role") == learned).alias("learn"),
                F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")).alias("head"),
                escape(F.col("text")).alias("body"))
    turns = said.groupBy("tree", "path_rank").agg(
        F.first("path_score").alias("path_score"),
        F.array_sort(F.collect_list(F.struct("depth", "learn", "head", "body"))).alias("turns"))
    whole = F.concat(F.lit(START), F.array_join(F.transform(
        "turns", lambda x: F.concat(x["head"], x["body"], F.lit(TURN_END))), ""), F.lit(END))
    # Starts and ends follow from running lengths, kept in one fold over the turns.
    begin = F.struct(F.lit(len(START)).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, x):
        start = state["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        spans = F.when(x["learn"], F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))) \
            .otherwise(state["spans"])
        return F.struct((end + F.lit(len(TURN_END))).alias("at"), spans.alias("spans"))

    return turns.select("tree", "path_rank", "path_score", whole.alias("formatted"),
                        F.aggregate("turns", begin, step)["spans"].alias("loss_spans"))


def parsed(conversations: DataFrame) -> DataFrame:
    """Read ``formatted`` back: adds ``turns`` (role, text) and ``loss_texts``, both unescaped."""
    inner = F.substring(F.col("formatted"), len(START) + 1,
                        F.length("formatted") - F.lit(len(START) + len(END)))
    pieces = F.filter(F.split(inner, r"<\|end\|>\n"), lambda p: F.length(p) > 0)
    turn = lambda p: F.struct(
        unescape(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>\n", 1)).alias("role"),
        unescape(F.regexp_replace(p, r"(?s)^<\|.*?\|>\n", "")).alias("text"))
    masked = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return conversations.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_texts", masked)
