r"""Chat formatting of reply trees, in DataFrame functions only.

A tree's rows point to their parents. Iterative self-joins over doubling distances give each node its depth and
the score of its path, then list the nodes of each chosen root-to-leaf path: about log2(depth) joins of narrow
rows, and no path is ever carried as an array. Each chosen path becomes one conversation.

The template marks a turn as ``<|im_start|>role\ntext<|im_end|>\n``. Inside roles and texts, a control string
never appears: a backslash becomes ``\0`` and every control string gets ``\2`` after its first character, which
unescape() takes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import P, written

START, END = "<|im_start|>", "<|im_end|>\n"
#: What marks control strings here or in other common templates, and so is escaped inside texts.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    text = _replace(text, "\\", "\\0")
    for control in CONTROLS:
        text = _replace(text, control, control[0] + "\\2" + control[1:])
    return text


def unescape(text: Column) -> Column:
    return _replace(_replace(text, "\\2", ""), "\\0", "\\")


def _role(role: Column) -> Column:
    return _replace(escape(role), "\n", "\\1")


def _unrole(role: Column) -> Column:
    return _replace(_replace(_replace(role, "\\1", "\n"), "\\2", ""), "\\0", "\\")


def chain(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as trees without branches: (tree, node, parent, role, text, score); each row answers the one before.

    Order: turn, nulls first, then role and text, so repeated turns all stay. Null role and text are empty. A null
    conversation id is a conversation of its own.
    """
    rows = turns.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, node, depth): the nodes of the `best` root-to-leaf paths of each tree.

    nodes: tree, node (unique in its tree), parent (null: a root; one that no row has counts as null) and score
    (null: 0). Paths are ranked by the sum of their scores, then by their leaf; None keeps all.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ids = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = ids.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    at = ids.join(known, same("tree", "t") & (F.col("parent") == F.col("p")), "left").select("tree", "node", F.col("p").alias("up"), "score", F.lit(1).cast("long").alias("far"))
    at = written(at, "jump")
    # up: the ancestor 2^k above; score and far: summed over the nodes below it. Nodes that reach their root are
    # done and leave the joins.
    done, live, jumps = at.filter("up is null"), at.filter("up is not null"), []
    while not live.isEmpty():
        jumps.append(live)
        above = done.unionByName(live).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("far").alias("far2"))
        joined = live.join(above, same("tree", "t") & (F.col("up") == F.col("n")))
        at = written(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("far") + F.col("far2")).alias("far")), "jump")
        done, live = done.unionByName(at.filter("up is null")), at.filter("up is not null")
    inner = ids.select(F.col("tree").alias("t"), F.col("parent").alias("p")).filter("p is not null").distinct()
    leaves = done.join(inner, same("tree", "t") & (F.col("node") == F.col("p")), "left_anti").select("tree", F.col("node").alias("leaf"), "score", F.col("far").alias("depth"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    leaves = leaves.withColumn("rank", rank)
    if best is not None:
        leaves = leaves.filter(F.col("rank") <= best)
    got = leaves.withColumn("node", F.col("leaf"))
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"))
        more = got.join(jump, same("tree", "t") & (F.col("node") == F.col("n"))).select("tree", "leaf", "score", (F.col("depth") - (1 << k)).alias("depth"), "rank", F.col("next").alias("node"))
        got = written(got.select("tree", "leaf", "score", "depth", "rank", "node").unionByName(more), "paths")
    return got.select("tree", "leaf", "rank", "score", "node", "depth")


def format_paths(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss): one conversation for each path.

    loss: (start, end) in code points of formatted, of each assistant text as it stands there, in order.
    """
    c = chosen.select(F.col("tree").alias("t"), F.col("node").alias("n"), "leaf", "rank", F.col("score").alias("path_score"), "depth")
    rows = c.join(nodes, F.col("t").eqNullSafe(F.col("tree")) & (F.col("n") == F.col("node")))
    head = F.concat(F.lit(START), _role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    rows = rows.select("tree", "leaf", "rank", "path_score", "depth", "role", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    upto = F.sum(F.char_length("head") + F.char_length("body") + len(END)).over(Window.partitionBy("tree", "leaf").orderBy("depth"))
    rows = rows.withColumn("end", upto - len(END))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("end") - F.char_length("body")).alias("start"), F.col("end").alias("end")))
    turn = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("s"), span.alias("span"))
    told = rows.groupBy("tree", "leaf", "rank", "path_score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return told.select("tree", "leaf", "rank", F.col("path_score").alias("score"), F.array_join("turns.s", "").alias("formatted"), F.filter("turns.span", lambda x: x.isNotNull()).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The (role, text) of each turn, from the formatted string alone."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    return F.transform(turns, lambda x: F.struct(_unrole(F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)).alias("role"), unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text")))


def under_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss. See chain() for nulls and repeated rows."""
    nodes = written(chain(turns, conv, turn, role, text), "nodes")
    return format_paths(nodes, paths(nodes)).select(F.col("tree").alias("conv_id"), "formatted", "loss")
