"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text becomes a vector of transformed statistics (lengths, shares of kinds of characters,
repetition of words and lines), in one pass. Vectors, not texts, are joined with labels. The labelled
rows give, for each class, a count, a mean and a covariance, from sums that Spark adds up over all of them; each covariance is shrunk towards the
pooled one and towards its diagonal. A score is the logistic function of the difference of the two
Mahalanobis log-densities plus the log of the class shares, computed with the inverses of the
Cholesky factors, which are made once on the driver.

Null and empty texts are vectors like others (all counts 0) and get a score. Labels that are null or
neither 0 nor 1 are not learnt from. With labelled rows of one class only, every score is that class;
with none at all, every score is 0.5. Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolary.llm.common import lean, small_batches
from symbolary.sources.shared import cut
from symbolary.sources.tables import table

#: Shares of the pooled covariance and of the diagonal in a class covariance.
POOLED, DIAGONAL = 0.3, 0.1

_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:'\"-?()"]] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_ODD = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _STOP | _HIGH)

FEATURES = (
    "log_bytes", "upper", "digit", "space", "stop", "odd", "bar", "bang", "high", "log_word", "words_distinct", "lines_distinct", "log_lines", "log_line_words", "short_words", "capitalised",
)


#: Shares in ordinary prose, which stand for CHARS characters or WORDS words that each text is given besides its own:
#: the shares of a few words tell little, and a text without any is ordinary.
CHARS, WORDS, LINES = 60.0, 12.0, 1.0
PRIOR = {"upper": 0.03, "digit": 0.002, "space": 0.16, "stop": 0.03, "odd": 0.0005, "bar": 0.0005, "bang": 0.0005, "high": 0.03, "words_distinct": 0.8, "lines_distinct": 1.0, "short_words": 0.4, "capitalised": 0.13}


def features(text: str | None) -> list[float]:
    """Transformed statistics: logarithms of counts, arcsines of the roots of shares."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, int)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w, m = len(words), len(lines)
    letters = int(seen[_LOWER].sum() + seen[_UPPER].sum())

    def share(name: str, x: int, of: int, more: float) -> float:
        return float(np.arcsin(np.sqrt(min(1.0, (x + more * PRIOR[name]) / (of + more)))))

    return [
        float(np.log1p(n)), share("upper", seen[_UPPER].sum(), letters, CHARS), share("digit", seen[_DIGIT].sum(), n, CHARS), share("space", seen[_SPACE].sum(), n, CHARS), share("stop", seen[_STOP].sum(), n, CHARS), share("odd", seen[_ODD].sum(), n, CHARS), share("bar", seen[124], n, CHARS), share("bang", seen[33], n, CHARS), share("high", seen[_HIGH].sum(), n, CHARS),
        float(np.log((sum(map(len, words)) + 6 * WORDS) / (w + WORDS))), share("words_distinct", len(set(words)), w, WORDS), share("lines_distinct", len(set(lines)), m, LINES), float(np.log1p(m)), float(np.log((w + WORDS) / (m + LINES))), share("short_words", sum(len(x) < 4 for x in words), w, WORDS), share("capitalised", sum(x[:1].isupper() for x in words), w, WORDS),
    ]


@dataclass(frozen=True)
class Model:
    """Class log-shares, means, inverses of Cholesky factors and log-determinants; `fixed` where a class is missing."""

    prior: tuple[float, float] = (0.0, 0.0)
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    logdet: tuple[float, float] = (0.0, 0.0)
    fixed: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1 for each row."""
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        density = [self.prior[k] - 0.5 * self.logdet[k] - 0.5 * (((x - self.means[k]) @ self.whiten[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x: the statistics of each row's text, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            flat = [v for t in batch.column("text") for v in features(t.as_py())]
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float64()))], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _sums(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each class of rows (y, x): count, sums and sums of products, added up by Spark; at most two rows' worth reaches the driver."""
    d = len(FEATURES)

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y, x = batch.column("y").to_numpy(zero_copy_only=False), _matrix(batch.column("x"))
            for k in (0, 1):
                one = np.c_[np.ones((y == k).sum()), x[y == k]]
                total[k] = total.get(k, 0) + one.T @ one
        for k, m in total.items():
            flat = m.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["y", "at", "x"])

    out = {k: np.zeros((d + 1) ** 2) for k in (0, 1)}
    for r in rows.mapInArrow(lean(partial), "y int, at int, x double").groupBy("y", "at").agg(F.sum("x").alias("x")).collect():
        out[r.y][r.at] = r.x
    return {k: v.reshape(d + 1, d + 1) for k, v in out.items()}


def fit_vectors(found: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", held_out: bool = True) -> Model:
    """Fit on all labelled vectors (id, x); with `held_out`, without those whose crc32(id as text) mod 3 is 1.

    Ids of labels are joined with those of vectors as they are; each labelled document counts once for each label row.
    """
    y = labels.select(labels[label_id].alias("__id"), labels[label_col].cast("int").alias("y")).where("y in (0, 1)")
    if held_out:
        y = y.where(F.crc32(F.col("__id").cast("string")) % 3 != 1)
    sums = _sums(found.join(y, found.id == F.col("__id")).select("y", "x"))
    n = [sums[k][0, 0] for k in (0, 1)]
    if min(n) < 2:
        return Model(fixed=0.5 if max(n) == 0 or n[0] == n[1] else float(n[1] > n[0]))
    means = [sums[k][0, 1:] / n[k] for k in (0, 1)]
    scatter = [sums[k][1:, 1:] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    whiten, logdet = [], []
    for k in (0, 1):
        own = (1 - POOLED) * scatter[k] / n[k] + POOLED * pooled
        own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(own)) + 1e-5 * np.eye(len(own))
        root = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(root))
        logdet.append(2 * float(np.log(np.diag(root)).sum()))
    return Model(tuple(float(np.log(x / sum(n))) for x in n), np.array(means), np.array(whiten), tuple(logdet))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: bool = True) -> Model:
    """Like fit_vectors, from texts; labels name a document by a column called as that of the documents."""
    return fit_vectors(vectors(docs, id_col, text_col), labels, id_col, label_col, held_out)


def score_vectors(found: DataFrame, model: Model) -> DataFrame:
    """id, score of vectors (id, x)."""
    schema = T.StructType([found.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.scores(_matrix(batch.column("x"))))], names=schema.names)

    return found.mapInArrow(lean(run), schema)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of docs and the score, in one pass without a shuffle; a column named like `out` is replaced."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")  # pandas would stay in the workers' memory
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(np.array([features(t.as_py()) for t in texts], float).reshape(-1, len(FEATURES))))

    return docs.withColumn(out, scored(docs[text_col]))


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, from statistics that are computed once and kept."""
    found = cut(vectors(table(spark, sf_dir, "documents")))
    scored = score_vectors(found, fit_vectors(found, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op8_quality_qda": op8_quality_qda}
ORACLES: dict[str, str] = {}
