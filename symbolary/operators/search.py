"""Vocabulary and question answering over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symbolary.functions.names import all_forms, is_test, question, spellings, words
from symbolary.operators.graph import degrees

EXACT, TOKEN, PREFIX, SUBSTRING, DOC, PATH, KIND = 1000.0, 300.0, 100.0, 1.0, 20.0, 0.5, 150.0
TEST_SHARE, PER_NAME = 0.05, 2
PROSE_KINDS = ("rationale", "claim", "document")


def prose_for(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, prose: what docstrings (symbol to text) and claims (text to symbol) say of a symbol, in edge order.

    Edges need an `ordinal`, text nodes a `text`.
    """
    texts = nodes.where("text is not null").select(F.col("id").alias("tid"), "text")
    said = edges.where("relation in ('rationale_for', 'describes')").select(F.when(F.col("relation") == "describes", F.col("target")).otherwise(F.col("source")).alias("id"), F.when(F.col("relation") == "describes", F.col("source")).otherwise(F.col("target")).alias("tid"), "ordinal")
    held = said.join(texts, "tid").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("all"))
    return held.select("id", F.array_join(F.transform("all", lambda x: x["text"]), " ").alias("prose"))


def search_rows(nodes: DataFrame, prose: DataFrame | None = None, claims: bool = False) -> DataFrame:
    """One row of features for each node that can answer: words and spellings of its name, path and prose."""
    rows = nodes.where(~F.col("kind").isin(*(k for k in PROSE_KINDS if not (claims and k == "claim"))))
    rows = rows.join(prose, "id", "left") if prose is not None else rows.withColumn("prose", F.lit(None).cast("string"))
    said = F.coalesce("prose", F.lit(""))
    spelt = all_forms(words(F.col("label")))
    return rows.select(
        "id", F.lower("label").alias("label"), spelt.alias("name_forms"), F.lower("file").alias("path"), all_forms(words(F.col("file"))).alias("path_forms"), all_forms(words(said)).alias("doc_forms"),
        "kind", is_test(F.col("file"), F.col("label")).alias("is_test"), F.greatest(F.lit(1), F.size(spelt)).alias("n_words"), F.length("label").alias("label_len"),
    )


def _hits(said: list[str]) -> tuple:
    """Column tests of one term's spellings: name is one, in the name's words, at its start, within, in prose, in path."""
    any_of = lambda tests: F.greatest(*tests) if len(tests) > 1 else tests[0]
    lits = F.array(*map(F.lit, said))
    return (
        F.col("label").isin(*said), F.arrays_overlap("name_forms", lits), any_of([F.startswith("label", F.lit(s)) for s in said]), any_of([F.contains("label", F.lit(s)) for s in said]),
        F.arrays_overlap("doc_forms", lits), F.arrays_overlap("path_forms", lits) | any_of([F.contains("path", F.lit(s)) for s in said]),
    )


def idf(rows: DataFrame, terms: list[str]) -> DataFrame:
    """term, seen, weight: ln(1 + N / (1 + seen)), where seen counts rows whose name has the term.

    All terms are counted in one pass; the result is one row for each.
    """
    counts = []
    for i, t in enumerate(terms):
        _, token, _, within, _, _ = _hits(spellings(t))
        counts.append(F.count_if((F.col("kind") != "claim") & (token | within)).alias(f"s{i}"))
    whole = rows.agg(F.count("*").alias("n"), *counts)
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"s{i}").alias("seen")) for i, t in enumerate(terms))))
    return whole.select("n", each.alias("x")).select("x.term", "x.seen", F.log(1 + F.col("n") / (1 + F.col("x.seen"))).alias("weight"))


def scores(rows: DataFrame, terms: list[str], kind: str | None) -> DataFrame:
    """id, label, kind, label_len, score of the rows that a question reaches.

    A question's few terms are columns: each row is scored where it lies, in one pass, without a join of rows and terms.
    """
    weights = idf(rows, terms).agg(*(F.max(F.when(F.col("term") == t, F.col("weight"))).alias(f"w{i}") for i, t in enumerate(terms)))
    held = rows.join(F.broadcast(weights))  # one row
    tiered, more, matched = F.lit(0.0), F.lit(0.0), F.lit(0)
    for i, t in enumerate(terms):
        exact, token, prefix, within, doc, path = _hits(spellings(t))
        w, claim = F.col(f"w{i}"), F.col("kind") == "claim"
        tier = F.when(claim, F.when(doc, DOC).otherwise(0.0)).when(exact, EXACT).when(token, TOKEN).when(prefix, PREFIX).when(within, 0.0).when(doc, DOC).otherwise(0.0)
        hit = F.when(claim, doc).otherwise(exact | token | prefix | within | doc)
        tiered = tiered + w * tier
        more = more + w * F.when(~claim & ~exact & ~token & ~prefix & within, SUBSTRING).otherwise(0.0) + w * F.when(~claim & path, PATH).otherwise(0.0)
        matched = matched + hit.cast("int")
    share = F.col("matched") / float(len(terms))
    bonus = F.when(F.col("kind") == kind, KIND).otherwise(0.0) if kind else F.lit(0.0)
    summed = held.select("id", "label", "kind", "label_len", "n_words", "is_test", tiered.alias("tiered"), more.alias("more"), matched.alias("matched"))
    total = (F.col("tiered") / F.sqrt("n_words") * share * share + F.col("more") + bonus) * F.when(F.col("is_test"), TEST_SHARE).otherwise(1.0)
    return summed.select("id", "label", "kind", "label_len", F.round(total, 6).alias("score")).where("score > 0")


def ranked(rows: DataFrame, edges: DataFrame, asked: str, limit: int = 6) -> DataFrame:
    """rank, id, label, score: the best answers to a question, at most PER_NAME of a name."""
    terms, kind = question(asked)
    if not terms:
        return rows.sparkSession.createDataFrame([], "rank int, id string, label string, score double")
    found = scores(rows, terms, kind).join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = (F.desc("score"), F.desc("degree"), "label_len", "id")
    few = found.withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy(*order))).where(F.col("nth") <= PER_NAME).orderBy(*order).limit(limit)
    return few.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "id", "label", "score")


def more(rows: DataFrame, asked: str, limit: int = 6) -> DataFrame:
    """scored, more: how many rows a question reaches, and how many a list of `limit` leaves out at least."""
    terms, kind = question(asked)
    return scores(rows, terms, kind).agg(F.count("*").alias("scored")).select("scored", F.greatest(F.lit(0), F.col("scored") - limit).cast("long").alias("more"))


def name_ids(nodes: DataFrame) -> DataFrame:
    """label, ids (how many), max degree apart: the names that can be asked for."""
    return nodes.where(~F.col("kind").isin(*PROSE_KINDS)).groupBy("label").agg(F.count("*").alias("ids"))


def ranked_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """label, degree: the degree of the best connected node of each name."""
    rows = nodes.where(~F.col("kind").isin(*PROSE_KINDS)).select("id", "label")
    return rows.join(degrees(edges), "id", "left").groupBy("label").agg(F.max(F.coalesce("degree", F.lit(0))).cast("long").alias("degree"))


def word_vocabulary(nodes: DataFrame, low: int = 3, high: int = 30) -> DataFrame:
    """word: the distinct words of names."""
    names = nodes.where(~F.col("kind").isin(*PROSE_KINDS)).select("label").distinct()
    return names.select(F.explode(words(F.col("label"))).alias("word")).where(F.length("word").between(low, high)).distinct()
