"""Attaching prose to symbols that exist: mentions, menus of candidates, and taking in answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symbolary.operators.graph import degrees

MENU, INDEX_MENTIONS, MIN_NAME, IDS, PICKS = 12, 30, 4, 4, 3
#: Tokens of a questionnaire, and characters of a passage in it.
ASK_BUDGET, ASK_CHARS = 120_000, 1200
TITLE, CODE, SHAPED, FENCED = 4, 3, 3, 1
_FENCE, _TICKS, _NAME, _CALL = r"(?s)```.*?```", r"`([^`\n]+)`", r"[A-Z_a-z][0-9A-Z_a-z]*(?:\.[A-Z_a-z][0-9A-Z_a-z]*)*", r"([A-Z_a-z][0-9A-Z_a-z]*)\("


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _parts(spans: Column) -> Column:
    """The parts between dots of every identifier in the spans."""
    return F.flatten(F.transform(F.flatten(F.transform(spans, lambda s: _all(s, _NAME))), lambda n: F.split(n, "[.]")))


def _shaped(part: Column) -> Column:
    """Whether a word of prose is spelt as only code is: capitalised, camel case or with an inner underscore."""
    capital = part.rlike("^[A-Z]") | part.rlike("^.+[A-Z]")
    return (capital & (F.upper(part) != part)) | F.contains(F.btrim(part, F.lit("_")), F.lit("_"))


def mentions(passages: DataFrame) -> DataFrame:
    """id, name, weight: names that a passage (id, title, text) mentions, and how strongly.

    A word of the title counts most, then what is marked or shaped as code in the prose, then fenced examples. One row
    for each mention leaves a passage; the largest weight of a name is an aggregate with map-side combining.
    """
    prose = F.regexp_replace("text", _FENCE, " ")
    weigh = lambda names, w: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(w).alias("weight")))
    shaped = F.filter(_parts(F.array(prose)), _shaped)
    found = F.concat(
        weigh(_parts(F.array(F.coalesce("title", F.lit("")))), TITLE), weigh(_parts(_all(prose, _TICKS, 1)), CODE), weigh(_all(prose, _CALL, 1), SHAPED), weigh(shaped, SHAPED), weigh(_parts(_all(F.col("text"), _FENCE)), FENCED),
    )
    rows = passages.select("id", F.explode(found).alias("m")).where(F.length("m.name") >= MIN_NAME)
    return rows.groupBy("id", F.lower("m.name").alias("name")).agg(F.max("m.weight").cast("int").alias("weight"))


def label_index(nodes: DataFrame, edges: DataFrame, ids: int = IDS) -> DataFrame:
    """name, id, nth: the best connected nodes of each lower-cased name; a file is known by its stem too."""
    real = nodes.where("kind not in ('rationale', 'claim', 'document')")
    stem = F.lower(F.regexp_replace("label", r"(?<=.)\.[^.]*$", ""))
    named = real.select("id", F.explode(F.array_distinct(F.when(F.col("kind") == "file", F.array(F.lower("label"), stem)).otherwise(F.array(F.lower("label"))))).alias("name")).where(F.length("name") >= MIN_NAME)
    order = W.partitionBy("name").orderBy(F.desc(F.coalesce("degree", F.lit(0))), F.length("id"), "id")
    return named.join(degrees(edges), "id", "left").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= ids).select("name", "id", "nth")


def menus(mentioned: DataFrame, index: DataFrame, limit: int = MENU) -> DataFrame:
    """passage, place, id: the closed list of candidates of a passage; none if it names more symbols than an index would."""
    real = mentioned.join(index.select("name").distinct(), "name", "left_semi")
    few = real.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") <= INDEX_MENTIONS).select("id")
    held = real.join(few, "id").withColumnRenamed("id", "passage").join(index, "name")
    best = held.groupBy("passage", "id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "name", "nth")).alias("key"))
    ranked = best.withColumn("place", F.row_number().over(W.partitionBy("passage").orderBy("key", "id"))).where(F.col("place") <= limit)
    return ranked.select("passage", "place", "id")


def digest(menu: DataFrame) -> DataFrame:
    """digest: 16 hex digits that change with any passage's menu.

    Each passage's menu is hashed where it lies, and the hashes of all passages are combined by an exclusive or and a sum,
    so that they need no order and meet in an aggregate with map-side combining.
    """
    each = menu.groupBy("passage").agg(F.sha2(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])), 256).alias("h"))
    key = F.sha2(F.concat(F.col("passage").cast("string"), F.lit("="), "h"), 256)
    words = [F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"w{i}") for i in range(4)]
    whole = each.select(*words).agg(*(F.bit_xor(f"w{i}").alias(f"x{i}") for i in (0, 1)), *(F.sum(f"w{i}").alias(f"x{i}") for i in (2, 3)), F.count("*").alias("n"))
    return whole.select(F.substring(F.sha2(F.concat_ws(",", *(F.coalesce(f"x{i}", F.lit(0)).cast("string") for i in range(4)), F.col("n").cast("string")), 256), 1, 16).alias("digest"))


def asked(passages: DataFrame, menu: DataFrame, mentioned: DataFrame, index: DataFrame, nodes: DataFrame, budget: int = ASK_BUDGET) -> DataFrame:
    """place, passage, block, tokens, kept: the passages worth asking about, as they are read; those that fit are kept.

    passages: id, place (in reading order), path, line, title, text. A passage is as strong as the best mention of a symbol
    in it; strong ones are bought first, ties in reading order, and one that doesn't fit is passed over.
    """
    from symbolary.functions.names import tokens
    from symbolary.operators.render import within_budget

    strength = mentioned.join(index.select("name").distinct(), "name", "left_semi").groupBy(F.col("id").alias("passage")).agg(F.max("weight").alias("strength"))
    named = nodes.select(F.col("id").alias("nid"), F.concat(F.lit("- `"), "id", F.lit("`: "), "label", F.lit(" ("), "kind", F.lit(", "), "file", F.lit(":L"), F.col("line").cast("string"), F.lit(")")).alias("option"))
    options = menu.join(named, menu.id == named.nid).groupBy("passage").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "option"))), lambda x: x["option"]), "\n").alias("options"))
    body = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, ASK_CHARS)
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("  "), "title")).otherwise("")
    rows = passages.join(options, passages.id == options.passage).join(strength, "passage")
    block = F.concat(F.lit("### "), F.col("id").cast("string"), title, F.lit("\n`"), "path", F.lit(":L"), F.col("line").cast("string"), F.lit("`\n\n> "), body, F.lit("\n\nCandidates:\n"), "options")
    rows = rows.select("place", "passage", block.alias("block"), tokens(block).alias("tokens"), F.struct((-F.col("strength")).alias("s"), "place").alias("o"))
    bought = within_budget(rows.select(F.lit(1).alias("request"), "o", "tokens"), "request", "o", "tokens", budget)
    return rows.join(bought.select(F.col("o.place").alias("place"), "kept"), "place").select("place", "passage", "block", "tokens", "kept")


def judged(menu: DataFrame, answers: DataFrame) -> DataFrame:
    """passage, id, verdict of every pick; and of every passage without one. answers: passage, picks (null if it was no list)."""
    asked = menu.select("passage").distinct()
    got = asked.join(answers.select("passage", "picks", F.lit(True).alias("answered")), "passage", "left")
    none = got.where("answered is null or picks is null").select("passage", F.lit(None).cast("string").alias("id"), F.when(F.col("answered").isNull(), "passage not answered").otherwise("answer was not a list").alias("verdict"))
    picks = got.where("picks is not null").select("passage", F.explode("picks").alias("raw")).select("passage", F.trim("raw").alias("id"))
    known = picks.join(menu.select("passage", "id", F.lit(True).alias("legal")).distinct(), ["passage", "id"], "left")
    verdict = F.when(F.col("id").isNull(), "pick was not an id").when(F.col("legal").isNull(), "id not on the candidate list").otherwise("accepted")
    return known.select("passage", "id", verdict.alias("verdict")).unionByName(none)


def accepted(verdicts: DataFrame, picks: int = PICKS) -> DataFrame:
    """passage, id: the accepted picks, the first few of each passage by id."""
    good = verdicts.where("verdict = 'accepted'").select("passage", "id").distinct()
    return good.withColumn("nth", F.row_number().over(W.partitionBy("passage").orderBy("id"))).where(F.col("nth") <= picks).drop("nth")


def rejections(verdicts: DataFrame) -> DataFrame:
    """verdict, n."""
    return verdicts.where("verdict <> 'accepted'").groupBy("verdict").agg(F.count("*").alias("n"))


def claims(chosen: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that accepted picks add. passages: id, path, line, title, text; a document is minted once."""
    from symbolary.functions.ids import claim_id, document_id

    used = passages.join(chosen.select(F.col("passage").alias("id")).distinct(), "id", "left_semi")
    document = used.select("path").distinct().select(document_id(F.col("path")).alias("id"), F.col("path").alias("label"), F.lit("document").alias("kind"), F.col("path").alias("file"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("text"))
    claim = used.select(claim_id(F.col("path"), F.col("line")).alias("id"), F.col("title").alias("label"), F.lit("claim").alias("kind"), F.col("path").alias("file"), F.col("line").cast("int").alias("line"), "text")
    holds = used.select(document_id(F.col("path")).alias("source"), claim_id(F.col("path"), F.col("line")).alias("target"), F.lit("contains").alias("relation"))
    says = chosen.select(F.col("passage"), F.col("id").alias("target")).join(used.select(F.col("id").alias("passage"), "path", "line"), "passage").select(claim_id(F.col("path"), F.col("line")).alias("source"), "target", F.lit("describes").alias("relation"))
    return document.unionByName(claim), holds.unionByName(says)
