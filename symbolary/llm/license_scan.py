"""Licence scan: a trained paragraph classifier over sparse word n-grams.

The model is a multinomial logistic regression over one- and two-word features of TEMPLATES (the families) and of
OTHER paragraphs (no licence, in the languages of the corpus), fitted on the driver when it is first needed, from these
texts only. Words of COMMON are features within pairs only, and pairs of them are none, so ordinary prose has few
features. A paragraph's scores are sums of its features' weights. The unknown class is calibrated: texts are scored by
models that were fitted without them (FOLDS), and the bias of `unknown` is set where these scores separate licences from
other paragraphs with the fewest errors, in the middle of that range. What no family has a probability of SURE for is
unknown. The best family is confirmed where the paragraph and one of the family's templates share CONFIRM of the
smaller one's features.

Everything on the data is DataFrame operations and every paragraph is scored: paragraphs are exploded to features, which
meet the weights in a join with a table that is as large as TEMPLATES and OTHER make it (some thousand rows, thus
broadcast), and are summed by paragraph. Only features of the model leave that join, and paragraphs without any are
unknown, as a check of the model at its making asserts. Nothing is grouped but a paragraph's own features.

A paragraph ends at a line end, unless the next line goes on with a small letter (a broken line). Result: one row for each
paragraph that is a licence with a probability of at least REPORT: id, paragraph (from 0), family (unknown if none is
sure), probability (of the best family among all), share (of the best template), confirmed. Families of equal
probability: the first by name. Null, empty and other texts have no rows. Repeated rows give repeated results. Other
columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolary.llm.license_texts import COMMON, OTHER, TEMPLATES
from symbolary.sources.tables import table

CONFIRM, SURE, REPORT, FOLDS = 0.6, 0.5, 0.2, 4
#: Weight of the class without a licence; rounds, rate and penalty of the fit.
OTHER_WEIGHT, ROUNDS, RATE, PENALTY = 4.0, 200, 1.0, 0.0002
UNKNOWN = "unknown"

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_BROKEN, _ENDS = r"\r?\n([a-z])", r"[\r\n]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> list[str]:
    return re.findall(_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def features(w: list[str]) -> list[str]:
    pairs = (f"{a} {b}" for a, b in zip(w, w[1:]) if a not in COMMON or b not in COMMON)
    return sorted({*(x for x in w if x not in COMMON), *pairs})


def _fit(texts: list[tuple[list[str], int]], n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Features, weights and biases of n classes, by gradient descent with momentum. Families count alike, whatever number
    of texts they have, and the last class OTHER_WEIGHT times as much as one."""
    names = sorted({x for f, _ in texts for x in f})
    at = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(texts), len(names)))
    for i, (f, _) in enumerate(texts):
        x[i, [at[v] for v in f]] = 1
    y = np.eye(n)[[k for _, k in texts]]
    each = (1 / np.maximum(1, y.sum(0)))[y.argmax(1)] * np.where(y.argmax(1) == n - 1, OTHER_WEIGHT, 1.0)
    each = (each / each.sum())[:, None]
    weights, bias = np.zeros((len(names), n)), np.zeros(n)
    steps = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(ROUNDS):
        z = x @ weights + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gap = each * (p - y)
        steps = 0.9 * steps[0] - RATE * (x.T @ gap + PENALTY * weights), 0.9 * steps[1] - RATE * gap.sum(0)
        weights, bias = weights + steps[0], bias + steps[1]
    return names, weights, bias


def _variants(text: str) -> list[list[str]]:
    """A text, and without its first or last words, which stand for what its users change."""
    w = words(text)
    return [features(x) for x in (w, w[2:], w[:-2]) if len(x) > 1]


@lru_cache(1)
def model() -> tuple[tuple[str, ...], tuple[tuple[str, tuple[float, ...]], ...], tuple[float, ...]]:
    """Families; weights by feature; biases. The last family is unknown, whose weights are those of OTHER."""
    families = (*sorted(TEMPLATES), UNKNOWN)
    texts = [(t, k) for k, f in enumerate(families[:-1]) for t in TEMPLATES[f]] + [(t, len(families) - 1) for t in OTHER]
    margins, known = [], []
    for fold in range(FOLDS):
        names, weights, bias = _fit([(f, k) for i, (t, k) in enumerate(texts) if i % FOLDS != fold for f in _variants(t)], len(families))
        at = {x: i for i, x in enumerate(names)}
        for i, (t, k) in enumerate(texts):
            if i % FOLDS == fold:
                z = bias + weights[[at[x] for x in features(words(t)) if x in at]].sum(0)
                margins.append(z[:-1].max() - z[-1])
                known.append(k < len(families) - 1)
    margins, known = np.array(margins), np.array(known)
    cuts = np.sort(margins)
    middles = (cuts[1:] + cuts[:-1]) / 2
    errors = np.array([((margins > c) != known).sum() for c in middles])
    best = middles[errors == errors.min()]
    names, weights, bias = _fit([(f, k) for t, k in texts for f in _variants(t)], len(families))
    bias[-1] += (best.min() + best.max()) / 2
    # a paragraph without a feature is no licence, so that it needs no row
    p = np.exp(bias - bias.max())
    if 1 - p[-1] / p.sum() >= REPORT:
        bias[-1] += np.log((p[:-1].sum() / p[-1]) / (REPORT / (1 - REPORT))) + 1e-3
    return families, tuple((n, tuple(round(float(v), 6) for v in w)) for n, w in zip(names, weights, strict=True)), tuple(round(float(b), 6) for b in bias)


def templates() -> list[tuple[str, int, list[str]]]:
    """(family, number, features) of each template."""
    return [(f, i, features(words(t))) for f in sorted(TEMPLATES) for i, t in enumerate(TEMPLATES[f])]


def _paragraph_words(text: Column) -> Column:
    return F.array_remove(F.split(F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), _BETWEEN, -1), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, paragraph, family, probability, share, confirmed."""
    spark = docs.sparkSession
    families, weights, bias = model()
    rows = docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), docs[text_col].alias("text"))
    parts = rows.select("id", "row", F.posexplode_outer(F.split(F.regexp_replace("text", _BROKEN, " $1"), _ENDS)).alias("paragraph", "line"))
    pairs = F.expr("case when size(w) > 1 then transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i])) else cast(array() as array<string>) end")
    split = parts.select("id", "row", "paragraph", _paragraph_words(F.col("line")).alias("w"))
    found = split.select("id", "row", "paragraph", F.concat("w", pairs).alias("f"))
    rows_ = ", ".join(f"('{n}', array({', '.join(f'{v!r}D' for v in w)}))" for n, w in weights)
    table_ = spark.sql(f"select * from values {rows_} as t(feature, weight)")
    rows_ = ", ".join(f"('{f}', {i}, '{x}')" for f, i, fs in templates() for x in fs)
    held = spark.sql(f"select * from values {rows_} as t(family, number, feature)")
    held = held.groupBy("feature").agg(F.collect_list(F.concat_ws("/", "family", "number")).alias("names"))
    known = table_.join(held, "feature", "left")
    # only features of the model go on; a feature counts once for a paragraph
    hits = found.select("id", "row", "paragraph", F.explode_outer("f").alias("feature")).join(F.broadcast(known), "feature")
    once = hits.groupBy("row", "paragraph").agg(F.first("id").alias("id"), F.collect_set(F.struct("feature", "weight", "names")).alias("hits"))
    zero = F.array(*(F.lit(b) for b in bias))
    z = F.aggregate("hits", zero, lambda a, h: F.zip_with(a, h["weight"], lambda x, y: x + y))
    names = F.flatten(F.transform("hits", lambda h: F.coalesce(h["names"], F.array().cast("array<string>"))))
    scores = once.select("id", "row", "paragraph", F.size("hits").alias("size"), names.alias("names"), F.transform(z, lambda v: F.round(v, 6)).alias("z"))
    top = F.array_max("z")
    best = F.element_at(F.array(*map(F.lit, families)), F.array_position(F.slice("z", 1, len(families) - 1), F.array_max(F.slice("z", 1, len(families) - 1))).cast("int"))
    each = F.transform("z", lambda v: F.exp(v - top))
    share_of = lambda v: v / F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    scored = scores.select("id", "row", "paragraph", "size", "names", best.alias("best"), F.round(share_of(F.exp(F.array_max(F.slice("z", 1, len(families) - 1)) - top)), 4).alias("probability"), F.round(1 - share_of(F.exp(F.element_at("z", -1) - top)), 4).alias("any"))
    scored = scored.where(F.col("any") >= REPORT).withColumn("family", F.when(F.col("probability") < SURE, UNKNOWN).otherwise(F.col("best")))
    sizes = {(f, i): len(fs) for f, i, fs in templates()}
    shared = F.transform(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(f"{f}/{i}").alias("name"), F.lit(n).alias("n")) for (f, i), n in sizes.items())), lambda t: F.struct(t["family"].alias("family"), (F.size(F.filter("names", lambda x: x == t["name"])) / F.least(t["n"], F.greatest("size", F.lit(1)))).alias("s")))
    share = F.round(F.coalesce(F.array_max(F.transform(F.filter(shared, lambda t: t["family"] == F.col("family")), lambda t: t["s"])), F.lit(0.0)), 4)
    return scored.select(F.col("id").alias(id_col), F.col("paragraph").cast("long").alias("paragraph"), "family", "probability", share.alias("share"), ((F.col("family") != UNKNOWN) & (share >= CONFIRM)).alias("confirmed"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents."""
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in SQL, with the weights as values."""
    families, weights, bias = model()
    k = len(families)
    rows = ", ".join(f"('{n}', {list(w)})" for n, w in weights)
    held = ", ".join(f"('{f}', {i}, '{x}', {len(fs)})" for f, i, fs in templates() for x in fs)
    z = ", ".join(f"round(sum(weight[{i + 1}]) + {b}, 6)" for i, b in enumerate(bias))
    return f"""
with weights(feature, weight) as (values {rows}),
held(family, number, feature, n) as (values {held}),
lines as (select row_number() over () as r, doc_id, string_split_regex(regexp_replace(text, '\\r?\\n([a-z])', ' \\1', 'g'), '[\\r\\n]+') as lines from documents where text is not null),
parts as (select r, doc_id, i - 1 as paragraph, lines[i] as line from (select *, unnest(range(1, len(lines) + 1)) as i from lines)),
words as (select r, doc_id, paragraph, regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from parts),
feats as (select r, doc_id, paragraph, unnest(list_distinct(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as feature from words),
each as (select r, doc_id, paragraph, feature, weight from feats join weights using (feature)),
z as (select r, doc_id, paragraph, count(*) as size, [{z}] as z from each group by all),
best as (select *, {list(families)}[list_position(z[1:{k - 1}], list_max(z[1:{k - 1}]))] as best, list_sum([exp(v - list_max(z)) for v in z]) as total from z),
sure as (select *, round(exp(list_max(z[1:{k - 1}]) - list_max(z)) / total, 4) as probability, round(1 - exp(z[{k}] - list_max(z)) / total, 4) as any_ from best),
fam as (select r, doc_id, paragraph, size, probability, case when probability < {SURE} then '{UNKNOWN}' else best end as family from sure where any_ >= {REPORT}),
shares as (select e.r, e.paragraph, h.family, count(*) / least(any_value(n), greatest(any_value(size), 1)) as s from each e join fam using (r, paragraph) join held h using (feature) group by e.r, e.paragraph, h.family, h.number),
top as (select r, paragraph, family, max(s) as s from shares group by all)
select doc_id, paragraph, family, probability, round(coalesce(s, 0.0), 4)::double as share, family <> '{UNKNOWN}' and round(coalesce(s, 0.0), 4) >= {CONFIRM} as confirmed
from fam left join top using (r, paragraph, family)
"""


QUERIES = {"op3_license_scan": op3_license_scan}


def __getattr__(name: str):
    """ORACLES, whose weights are fitted when it is first asked for."""
    if name == "ORACLES":
        return {"op3_license_scan": oracle()}
    raise AttributeError(name)
