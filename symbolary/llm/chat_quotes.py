"""Chat formatting: quotation linking.

A line that begins with > marks is quoted, as deep as it has marks. Consecutive lines of one depth are a passage; its
text, lower-cased and with white space as single spaces, is hashed. Unquoted lines of every message are hashed too, as
passages of one line, of the runs between quotes, and as whole messages. A quoted passage belongs to the first
earlier message of the conversation that has its hash; passages that match nothing as a whole are looked up line by
line. The message that a message replies to is the latest of those that its passages of depth 1 belong to. Replies give
trees; a message's root and depth come from pointer jumping, and root, then turn, is the reply order. Texts keep their
unquoted lines, without the line that introduces a quote ("... wrote:").

Only DataFrame operations. Originals are reduced to the first turn of each hash before they are joined, so a phrase that
all messages hold is one row; no group of a conversation is ever gathered. Null and empty texts quote nothing and stay
empty; rows with a null conversation or turn are kept, without links. Rows that repeat a turn count as one message for
links. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolary.sources.shared import cut
from symbolary.sources.tables import table

_MARKS = r"^\s*((?:>\s?)+)"
_WROTE = r"(?i)^\s*\S.*\b(?:wrote|schrieb|a écrit|escribió)\b.*:\s*$"


def _lines(text: Column) -> Column:
    """(depth, line without marks) of every line."""
    split = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    return F.transform(split, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), r"[^>]", "")).alias("depth"), F.regexp_replace(x, _MARKS, "").alias("line")))


def _own(lines: Column) -> Column:
    """The unquoted lines, without one that introduces a quote."""
    after = lambda i: F.coalesce(F.get(lines, i + 1)["depth"], F.lit(0))
    marked = F.transform(lines, lambda x, i: F.struct(((x["depth"] == 0) & ~((after(i) > 0) & x["line"].rlike(_WROTE))).alias("keep"), x["line"].alias("line")))
    return F.transform(F.filter(marked, lambda x: x["keep"]), lambda x: x["line"])


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def _runs(lines: Column) -> Column:
    """(depth, text) of each run of lines of one depth. `lines` is a column that is there already, as it is read line by line."""
    starts = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | (x["depth"] != F.get(lines, i - 1)["depth"]), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(lines), F.lit(1))), F.array(F.size(lines)))
    spans = F.when(F.size(lines) > 0, F.arrays_zip(starts.alias("a"), ends.alias("b"))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    return F.transform(spans, lambda s: F.struct(F.get(lines, s["a"])["depth"].alias("depth"), F.array_join(F.transform(F.slice(lines, s["a"] + 1, s["b"] - s["a"]), lambda x: x["line"]), " ").alias("line")))


def _passages(found: DataFrame) -> DataFrame:
    """conv, turn, depth, whole, hash: quoted passages (whole) and their lines."""
    quoting = found.where(F.exists("lines", lambda x: x["depth"] > 0))
    whole = quoting.select("conv", "turn", F.explode(_runs(F.col("lines"))).alias("x"), F.lit(True).alias("whole"))
    single = quoting.select("conv", "turn", F.explode("lines").alias("x"), F.lit(False).alias("whole"))
    both = whole.unionByName(single).where("x.depth > 0").select("conv", "turn", "x.depth", "whole", _normal(F.col("x.line")).alias("text"))
    return both.where("text <> ''").select("conv", "turn", "depth", "whole", F.md5("text").alias("hash"))


def _originals(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """conv, hash, origin: the first turn with an own line, run of lines or text of this hash, of conversations that quote."""
    rows = found.join(wanted.select("conv").distinct(), "conv", "left_semi")
    whole = rows.select("conv", "turn", _normal(F.array_join("own", " ")).alias("text"))
    runs = rows.select("conv", "turn", F.explode(_runs(F.col("lines"))).alias("x")).where("x.depth = 0").select("conv", "turn", _normal(F.col("x.line")).alias("text"))
    lines = rows.select("conv", "turn", F.explode("own").alias("line")).select("conv", "turn", _normal(F.col("line")).alias("text"))
    return whole.unionByName(runs).unionByName(lines).where("text <> ''").groupBy("conv", F.md5("text").alias("hash")).agg(F.min("turn").alias("origin"))


def parents(messages: DataFrame) -> DataFrame:
    """conv, turn, parent, n_quotes, n_linked of the messages that quote; messages: conv, turn, lines, own."""
    wanted = _passages(messages)
    first = _originals(messages, wanted)
    linked = wanted.join(first, ["conv", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    direct = F.when(F.col("depth") == 1, F.col("origin"))
    return linked.groupBy("conv", "turn").agg(
        F.coalesce(F.max(F.when(F.col("whole"), direct)), F.max(direct)).alias("parent"),
        F.sum(F.when(F.col("whole"), 1).otherwise(0)).alias("n_quotes"), F.count(F.when(F.col("whole"), F.col("origin"))).alias("n_linked"),
    )


def roots(links: DataFrame) -> DataFrame:
    """conv, turn, root, depth of messages with a parent, in as many rounds as the logarithm of the longest chain."""
    now = cut(links.where("parent is not null").select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("above"), F.col("depth").alias("more"))
        further = now.join(up, (now.conv == up.c) & (now.root == up.t), "left")
        new = cut(further.select("conv", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")))
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def link_quotes(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text (without quotes), parent_turn, root_turn, depth, n_quotes, n_linked: a row for each row."""
    lines = _lines(chats[text_col])
    rows = chats.select(chats[conv_col].alias("conv"), chats[turn_col].alias("turn"), chats[role_col].alias("role"), chats[text_col].alias("text"), lines.alias("lines"))
    rows = rows.withColumn("own", F.coalesce(_own(F.col("lines")), F.array().cast("array<string>")))
    quoting = F.coalesce(F.exists("lines", lambda x: x["depth"] > 0), F.lit(False))
    links = cut(parents(rows.where("conv is not null and turn is not null").select("conv", "turn", "lines", "own")))
    tree = links.join(roots(links), ["conv", "turn"], "left").select(F.col("conv").alias("c"), F.col("turn").alias("t"), "parent", "root", "depth", "n_quotes", "n_linked")
    out = rows.join(tree, (rows.conv == tree.c) & (rows.turn == tree.t), "left")
    text = F.when(quoting, F.trim(F.array_join("own", "\n"))).otherwise(F.coalesce("text", F.lit("")))
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), text.alias(text_col), F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )


def op9_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with what it replies to."""
    return link_quotes(table(spark, sf_dir, "conversations"))


QUERIES = {"op9_chat_quotes": op9_chat_quotes}
ORACLES: dict[str, str] = {}
