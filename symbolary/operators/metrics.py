"""Reports and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, value, n: counts by kind, by relation and by whether an edge is resolved; edges are read once for both."""
    kinds = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("kind").alias("what"), F.col("kind").alias("value"), "n")
    sets = edges.groupingSets([["relation"], ["resolved"]], "relation", "resolved").agg(F.count("*").alias("n"), F.grouping("relation").alias("g"))
    by = sets.select(F.when(F.col("g") == 0, "relation").otherwise("resolved").alias("what"), F.when(F.col("g") == 0, F.col("relation")).otherwise(F.col("resolved").cast("string")).alias("value"), "n")
    return kinds.unionByName(by)


def measure(nodes: DataFrame, edges: DataFrame, member: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """key, value: what a build consists of, one row for each number; parts of a number have its name before a dot.

    edges: source, target, relation, resolved, reason. member: id, group.
    """
    one = lambda df, key, value: df.agg(value.cast("long").alias("value")).select(F.lit(key).alias("key"), "value")
    by = lambda df, key, column: df.groupBy(column).agg(F.count("*").alias("value")).select(F.concat(F.lit(f"{key}."), F.col(column).cast("string")).alias("key"), "value")
    ids = nodes.groupBy("id").agg(F.count("*").alias("n"))
    loose = edges.where("resolved").join(ids.select(F.col("id").alias("target")), "target", "left_anti")
    rows = [
        one(nodes, "nodes_total", F.count("*")), one(nodes, "files_parsed", F.count_if(F.col("kind") == "file")), by(nodes, "nodes_by_kind", "kind"), one(ids, "ids_unique", F.count("*")), one(ids, "id_collisions", F.count_if(F.col("n") > 1)),
        one(edges, "edges_total", F.count("*")), one(edges, "edges_unresolved", F.count_if(~F.col("resolved"))), by(edges, "edges_by_relation", "relation"), one(loose, "dangling_edges", F.count("*")),
        by(edges.where("resolved and reason is not null"), "resolved_by_rule", "reason"), by(edges.where("not resolved and reason is not null"), "refusals_by_reason", "reason"),
        one(member, "shape.groups", F.countDistinct("group")), one(ids.join(member.select("id"), "id", "left_anti"), "shape.ungrouped", F.count("*")),
    ]
    if failed is not None:
        rows.append(one(failed, "files_failed", F.count("*")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def benchmark_scores(expected: DataFrame, ranked: DataFrame, top: int = 3) -> DataFrame:
    """repo, asked, right_file, right_function: how many problems have an expected file or function among the first answers.

    expected: repo, problem, file, function. ranked: problem, rank, file, function.
    """
    first = ranked.where(F.col("rank") <= top).select("problem", F.col("file").alias("f"), F.col("function").alias("n")).distinct()
    held = expected.join(first, "problem", "left").groupBy("repo", "problem").agg(
        F.max(F.coalesce(F.col("f") == F.col("file"), F.lit(False))).alias("file"), F.max(F.coalesce((F.col("f") == F.col("file")) & (F.col("n") == F.col("function")), F.lit(False))).alias("function"),
    )
    return held.groupBy("repo").agg(F.count("*").alias("asked"), F.count_if("file").alias("right_file"), F.count_if("function").alias("right_function"))


def metric_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """key, before, now, change (new, gone, same or changed) of metrics (key, value)."""
    a, b = before.select("key", F.col("value").alias("before")), now.select("key", F.col("value").alias("now"))
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("before") == F.col("now"), "same").otherwise("changed")
    return a.join(b, "key", "full_outer").select("key", "before", "now", change.alias("change"))


def question_ranks(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """corpus, question, rank: of the best expected answer in a ranked list, -1 if none is in it.

    answers: corpus, question, answer. ranked: corpus, question, rank, answer.
    """
    keys = ["corpus", "question", "answer"]
    return answers.join(ranked, keys, "left").groupBy("corpus", "question").agg(F.coalesce(F.min("rank"), F.lit(-1)).cast("int").alias("rank"))


def question_scores(ranks: DataFrame) -> DataFrame:
    """corpus, first, top3, asked."""
    return ranks.groupBy("corpus").agg(F.count_if(F.col("rank") == 1).alias("first"), F.count_if(F.col("rank").between(1, 3)).alias("top3"), F.count("*").alias("asked"))


def regressions(before: DataFrame, now: DataFrame) -> DataFrame:
    """corpus, question, was, is_: questions whose rank is worse than it was; -1 is worst."""
    keys = ["corpus", "question"]
    both = before.select(*keys, F.col("rank").alias("was")).join(now.select(*keys, F.col("rank").alias("is_")), keys)
    worse = lambda c: F.when(F.col(c) < 0, 1 << 30).otherwise(F.col(c))
    return both.where(worse("is_") > worse("was"))
