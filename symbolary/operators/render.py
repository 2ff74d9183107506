"""Answers: links of symbols in order of interest, and a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INVERSE = dict(calls="called by", contains="part of", describes="described in", imports="imported by", inherits="subclassed by", rationale_for="explains")
#: What is told first; places 8 and 9 are for both directions.
_FIRST = "inherits|subclassed by|calls|called by|imports|imported by|part of|contains".split("|")
ORDER = {k: i for i, k in enumerate(_FIRST)} | dict.fromkeys(("explains", "rationale_for"), 8) | dict.fromkeys(("described in", "describes"), 9)


def _map(of: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in of.items() for x in kv))


def links(edges: DataFrame) -> DataFrame:
    """id, relation, other, resolved: every edge from both of its ends."""
    there = edges.select(F.col("source").alias("id"), "relation", F.col("target").alias("other"), "resolved")
    back = edges.select(F.col("target").alias("id"), F.try_element_at(_map(INVERSE), F.col("relation")).alias("relation"), F.col("source").alias("other"), "resolved")
    return there.unionByName(back)


def interest(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """id, relation, other, label, rank of the seeds' links, the most telling first; gaps are shown with their ?name.

    Seeds reduce the edges before these are ranked.
    """
    near = links(edges).join(seeds.select("id").distinct(), "id", "left_semi").distinct()
    named = near.join(nodes.groupBy(F.col("id").alias("other")).agg(F.min("label").alias("label")), "other", "left").join(degree.withColumnRenamed("id", "other"), "other", "left")
    label = F.coalesce("label", F.col("other"))
    rows = named.select("id", "relation", "other", label.alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"))
    key = (F.try_element_at(_map(ORDER), F.col("relation")), F.startswith("label", F.lit("__")), F.startswith("label", F.lit("_")), F.desc("degree"), "label", "other")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(*key))).drop("degree")


def capped(ranked: DataFrame, per_node: int = 10) -> DataFrame:
    """id, shown, hidden: how many links a cap for each symbol shows and hides."""
    return ranked.groupBy("id").agg(F.count_if(F.col("rank") <= per_node).alias("shown"), F.count_if(F.col("rank") > per_node).alias("hidden"))


def provenance(file: Column, line: Column, origin: Column, resolved: Column, reason: Column) -> Column:
    """Where a statement comes from and how sure it is."""
    place = F.concat(file, F.lit(":L"), line.cast("string"))
    return F.concat(F.lit("["), F.when(origin == "doc", F.lit("doc ")).otherwise(F.lit("")), place, F.when(resolved, F.lit("")).otherwise(F.concat(F.lit(" unresolved: "), F.coalesce(reason, F.lit("?")))), F.lit("]"))


def within_budget(blocks: DataFrame, request: str, order: str, cost: str, budget: int) -> DataFrame:
    """request, order, kept: greedy by order; a block that doesn't fit is passed over, later smaller ones may still fit.

    What fits depends on what was taken before, so a request is one fold: its rows (no texts) stream through a task in order.
    """
    rows = blocks.select(request, order, F.col(cost).cast("long").alias("__cost")).repartition(request).sortWithinPartitions(request, order)
    schema = rows.select(request, order).schema.add("kept", "boolean")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, spent = None, 0
        for batch in batches:
            kept = []
            for of, c in zip(batch.column(request).to_pylist(), batch.column("__cost").to_pylist(), strict=True):
                if (of,) != last:
                    last, spent = (of,), 0
                kept.append(spent + c <= budget)
                spent += c * kept[-1]
            yield pa.RecordBatch.from_arrays([batch.column(request), batch.column(order), pa.array(kept, pa.bool_())], names=[request, order, "kept"])

    return rows.mapInArrow(fold, schema)


def shown_groups(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, group_name: the group that an answer names with a symbol, null where it would say nothing.

    groups: id, name, named_folder, size of each member's group. A group of more than 200 symbols that is at least 15 % of
    all tells nothing, nor does one that is named after another folder than the symbol's own.
    """
    whole = nodes.agg(F.count("*").alias("all"))
    own = F.regexp_extract("file", r"([^/]*)/[^/]*$", 1)
    rows = nodes.select("id", own.alias("own")).join(groups.select("id", "name", "named_folder", "size"), "id", "left").join(F.broadcast(whole))
    vast = (F.col("size") > 200) & (F.col("size") >= 0.15 * F.col("all"))
    elsewhere = (F.col("named_folder") != "") & (F.regexp_extract("named_folder", r"([^/]*)$", 1) != F.col("own"))
    return rows.select("id", F.when(~vast & ~elsewhere, F.col("name")).alias("group_name"))


def snippet(text: Column, most: int = 110) -> Column:
    """The beginning of a text on one line, cut behind `most` characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("..."))).otherwise(flat)
