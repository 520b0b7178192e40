"""Reply trees to training conversations, by DataFrame operations only.

Messages point to the message that they answer. Self-joins by doubling (each round joins the pointers to themselves, so
a pointer spans 1, 2, 4, ... replies) enumerate all root-to-leaf paths in a number of rounds that grows with the
logarithm of the depth. Branches are ranked by score; each chosen path is formatted as one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for a turn. Inside texts and roles every ``<`` followed by
backslashes (or none) and ``|`` gets one more backslash, so no control string can appear there; taking one away gives the
text back. In roles ``%`` and line breaks are percent-coded first. The loss mask is a list of spans (0-based start and
length, in code points) over the formatted text, one for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.session import written

#: Control strings of the template (fixed).
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Text without any ``<|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    """The inverse of escape_role()."""
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _same_tree(a: str, b: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def paths(nodes: DataFrame) -> DataFrame:
    """``tree``, ``leaf``, ``node`` and ``up`` (steps above the leaf) for each message on each root-to-leaf path.

    ``nodes`` has tree, node and parent, where (tree, node) is unique. A parent that isn't there counts as none. Messages
    on or below a cycle of replies have no root and are on no path.
    """
    ids = nodes.select("tree", "node")
    here = nodes.where("parent IS NOT NULL").alias("a").join(ids.alias("b"), _same_tree("a", "b") & (F.col("a.parent") == F.col("b.node")))
    hops = [written(here.select("a.tree", "a.node", F.col("a.parent").alias("above")), "reply-hops")]
    limit = nodes.count().bit_length()
    while not hops[-1].isEmpty() and len(hops) <= limit:
        twice = hops[-1].alias("a").join(hops[-1].alias("b"), _same_tree("a", "b") & (F.col("a.above") == F.col("b.node")))
        hops.append(written(twice.select("a.tree", "a.node", F.col("b.above").alias("above")), "reply-hops"))
    if not hops[-1].isEmpty():  # longer than all messages: replies in a cycle
        ids = ids.alias("a").join(hops[-1].alias("b"), _same_tree("a", "b") & (F.col("a.node") == F.col("b.node")), "left_anti")
    leaves = ids.alias("a").join(hops[0].alias("b"), _same_tree("a", "b") & (F.col("a.node") == F.col("b.above")), "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(hops) - 1)):
        higher = found.alias("a").join(hops[k].alias("b"), _same_tree("a", "b") & (F.col("a.node") == F.col("b.node")), "left")
        own = F.struct(F.col("a.node").alias("node"), F.col("up").alias("up"))
        beyond = F.when(F.col("b.above").isNotNull(), F.struct(F.col("b.above").alias("node"), (F.col("up") + (1 << k)).alias("up")))
        found = higher.select("a.tree", "leaf", F.inline(F.array_compact(F.array(own, beyond))))
        if k % 8 == 7:
            found = written(found, "reply-paths")
    return found


def format_trees(
    messages: DataFrame, *, tree_col: str = "tree_id", node_col: str = "message_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str | None = None, branches: int = 1, loss_role: str = "assistant"
) -> DataFrame:
    """One row for each chosen branch: tree id, ``leaf``, ``branch_rank`` (from 1), ``branch_score``, ``n_turns``, ``formatted`` and ``loss_spans``.

    A branch's score is the sum of its messages' scores (null, or no ``score_col``: 0); the ``branches`` best of a tree
    are kept, ties to the smaller leaf. Null roles and texts are empty. Messages with a null id are left out, of repeated
    (tree, message) ids one stays: the least by parent, role and text. A null tree id is a tree of its own. Messages on or below a cycle of
    replies are on no branch. Very long texts pass whole. An empty table gives no rows. Other columns don't pass, so none can clash.
    """
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    rows = messages.select(F.col(tree_col).alias("tree"), F.col(node_col).alias("node"), F.col(parent_col).alias("parent"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"), score.alias("score"))
    one = rows.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    nodes = written(one.select("tree", "node", "m.*"), "reply-nodes")
    steps = written(paths(nodes.select("tree", "node", "parent")), "reply-steps")
    if score_col:  # branches are ranked by ids and scores; texts are joined to the chosen ones alone
        scored = steps.alias("p").join(nodes.select("tree", "node", "score").alias("n"), _same_tree("p", "n") & (F.col("p.node") == F.col("n.node")))
        ranked = scored.groupBy("p.tree", "leaf").agg(F.sum("score").alias("branch_score"))
    else:
        ranked = steps.where("up = 0").select("tree", "leaf", F.lit(0.0).alias("branch_score"))
    ranked = ranked.withColumn("branch_rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))).where(F.col("branch_rank") <= branches)
    picked = steps.alias("p").join(ranked.alias("r"), _same_tree("p", "r") & (F.col("p.leaf") == F.col("r.leaf"))).select("p.tree", "p.leaf", "node", "up", "branch_score", "branch_rank")
    chosen = picked.alias("p").join(nodes.alias("n"), _same_tree("p", "n") & (F.col("p.node") == F.col("n.node"))).select("p.tree", "leaf", "up", "role", "text", "branch_score", "branch_rank")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    pieces = chosen.withColumns({"head": F.char_length(head).cast("long"), "body": F.char_length(escape(F.col("text"))).cast("long"), "piece": F.concat(head, escape(F.col("text")), F.lit(END))})
    before = W.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum(F.col("head") + F.col("body") + len(END)).over(before), F.lit(0)) + F.col("head"))
    span = F.when(F.col("role") == loss_role, F.struct("start", F.col("body").alias("length")))
    turns = pieces.groupBy("tree", "leaf").agg(F.first("branch_rank").alias("branch_rank"), F.first("branch_score").alias("branch_score"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece", span.alias("span")))).alias("turns"))
    return turns.select(
        F.col("tree").alias(tree_col), "leaf", "branch_rank", "branch_score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def chain(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by turn (ties: role, then text)."""
    at = F.row_number().over(W.partitionBy(conv_col).orderBy(turn_col, role_col, text_col)).cast("long")
    rows = conversations.select(conv_col, role_col, text_col, at.alias("message_id"))
    return rows.withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before escaping."""

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substr(x, F.char_length(role) + 2, F.char_length(x) - F.char_length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, in order, as they were before escaping."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
