"""Benchmark decontamination: a prefix-filtered set join of item windows with document words.

An item's windows are its runs of `window` consecutive words, or the whole item if it is shorter.
Words are ordered by their count over all documents. As a window must occur whole, its prefix is one
word: its rarest. Documents' words are joined with prefixes only; the word's place in the window gives
the only place where the window can start (positional bound), which must lie within the text (length
bound), and the words there are compared with the window's.

Everything is DataFrame operations. The windows are broadcast if the item words, which are counted
first, take at most BROADCAST_BYTES, and a document's words then never leave its row. Beyond that places
(id, place, word) are shuffled to the prefixes, hot words are left to the skew handling of adaptive
execution, and the words at a candidate start are fetched afterwards, from the documents that have one.

Null, empty or wordless texts have no words; such items have no windows. Items that share an id are
windows of one item. Repeated document rows give repeated results; other columns are ignored. With an
empty benchmark nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolary.sources.tables import table

WINDOW = 10
BROADCAST_BYTES = 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, after lower-casing.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain lower() where there are only ASCII characters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), _BETWEEN, -1), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item, win (array of words): every window of every item, once."""
    w = items.select(items[id_col].cast("string").alias("item"), words(items[text_col]).alias("w")).where("size(w) > 0 and item is not null")
    starts = F.expr(f"sequence(1, greatest(1, size(w) - {window - 1}))")
    return w.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), window).alias("win")).distinct()


def _prefixes(wins: DataFrame, docs: DataFrame, text_col: str, small: bool) -> DataFrame:
    """win, word, off (from 0): the rarest word of each distinct window, ties to the smaller word, then its first place."""
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    seen = docs.select(F.explode_outer(words(docs[text_col])).alias("word"))
    counts = seen.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    placed = wins.select("win").distinct().select("win", F.posexplode("win").alias("off", "word"))
    ranked = placed.join(F.broadcast(counts) if small else counts, "word").groupBy("win").agg(F.count("*").alias("found"), F.min(F.struct("n", "word", "off")).alias("p"))
    # a window of which a word is in no document can't occur
    return ranked.where("found = size(win)").select("win", "p.word", "p.off")


def _bytes(items: DataFrame, text_col: str) -> int:
    """Of the items' texts."""
    return items.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """id, key (of the text), item, start, len: each place in a document, in words from 0, where a window occurs."""
    wins = windows(items, item_col, "text", window)
    small = _bytes(items, "text") * window <= BROADCAST_BYTES
    prefix = _prefixes(wins, docs, text_col, small)
    held = wins.groupBy("win").agg(F.collect_set("item").alias("items")).join(prefix, "win").select("word", "off", "win", "items")
    w = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("key"), words(docs[text_col]).alias("w"))
    start = F.col("at") - F.col("off")
    if small:
        # the outer form, as the inner one has words() evaluated once more in a filter on its size; the join drops its nulls
        hits = w.select("id", "key", "w", F.posexplode_outer("w").alias("at", "word")).join(F.broadcast(held), "word")
        inside = hits.where((start >= 0) & (start + F.size("win") <= F.size("w")))
        hits = inside.where(F.slice("w", start + 1, F.size("win")) == F.col("win"))
        return hits.select("id", "key", F.explode("items").alias("item"), start.alias("start"), F.size("win").alias("len"))
    places = w.select("id", "key", F.size("w").alias("n"), F.posexplode_outer("w").alias("at", "word"))
    cand = places.join(held, "word").where((start >= 0) & (start + F.size("win") <= F.col("n")))
    cand = cand.select(F.col("id").alias("i"), F.col("key").alias("k"), start.alias("s"), "win", "items").distinct()
    some = w.join(cand.select("i", "k").distinct(), w.id.eqNullSafe(F.col("i")) & (w.key == F.col("k")), "left_semi")
    runs = some.select("id", "key", F.explode(F.expr(f"transform(w, (x, i) -> struct(i as at, slice(w, i + 1, {window}) as run))")).alias("r")).select("id", "key", "r.at", "r.run")
    hits = runs.join(cand, runs.id.eqNullSafe(cand.i) & (runs.key == cand.k) & (runs["at"] == cand.s))
    hits = hits.where(F.slice("run", 1, F.size("win")) == F.col("win")).select("id", "key", "s", "win", "items").distinct()
    return hits.select("id", "key", F.explode("items").alias("item"), F.col("s").alias("start"), F.size("win").alias("len"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each document row."""
    found = occurrences(docs, items, id_col, text_col, item_col, window)
    # what a document has of these is bounded by its length and the items
    places = F.flatten(F.transform(F.collect_set(F.struct("start", "len")), lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))
    per = found.groupBy(F.col("id").alias("hid"), F.col("key").alias("hkey")).agg(F.size(F.array_distinct(places)).alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    base = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("key"), F.size(words(docs[text_col])).cast("long").alias("n_words"))
    out = base.join(per, base.id.eqNullSafe(per.hid) & (base.key == per.hkey), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        base.id.alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no window occurs."""
    dirty = occurrences(docs, items, id_col, text_col, window=window).select("id", "key").distinct()
    d = docs.withColumn("__key", F.xxhash64(docs[text_col]))
    return d.join(dirty, d[id_col].eqNullSafe(dirty.id) & (d["__key"] == dirty.key), "left_anti").drop("__key")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
with d as (select doc_id, coalesce({_WORDS_SQL.format("text")}, []) as w from documents),
i as (select item_id, {_WORDS_SQL.format("text")} as w from benchmark),
win as (select distinct item_id, array_to_string(w[s:s + {WINDOW - 1}], ' ') as g, len(w[s:s + {WINDOW - 1}]) as n
        from (select item_id, w, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) as s from i where len(w) > 0)),
lens as (select distinct n from win),
place as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as s from d, lens),
g as (select place.doc_id, place.s, place.n, array_to_string(d.w[place.s:place.s + place.n - 1], ' ') as g from place join d using (doc_id)),
hit as (select g.doc_id, g.s, g.n, win.item_id from g join win on g.g = win.g and g.n = win.n),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by 1),
its as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from hit group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join its using (doc_id)
"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {"op6_decontamination": ORACLE}
