"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

1. A document's set of word shingles is hashed once; the hash's upper bits choose a bin, and each bin keeps its
   least hash. An empty bin borrows from a bin that a hash of its own number and the attempt picks, the same in
   every document, until that bin is not empty (optimal densification).
2. Documents with the same set are one class, of which the smallest id goes on; a class links its members.
3. Bands of ROWS bins are bucket keys. In a bucket each member is a candidate of the smallest id only, so a bucket of n
   members gives n - 1 candidates. Candidates are confirmed on the full sets.
4. Members get the label of what they are linked with. A bucket whose members all have one label is done; so is one of
   two members, and one of the same members as another one. In the others, members of different labels are still to
   be compared, all of them: full sets are dealt into parts of bounded size, and a task compares two parts (the
   members of the commonest label are not compared with one another). Only links leave a task, at most one less
   than it has members. So every two documents that share a bucket are compared or known to be linked.
5. Classes are the connected components of all links.

With 64 bands of 8 rows, a pair at a similarity of exactly 0.8 shares no bucket with a probability of 8e-6; that is all
that can be missed.

Null, empty and wordless texts have the empty set and link with nothing. Rows with a null id get results but take no
part in links. Repeated rows get the same result each. Other columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolary.llm.common import by_task, hashed_texts, hashes_of, lean, mix64, packed, power, shared_counts, shingle_hashes, small_batches, unpacked
from symbolary.operators.components import components
from symbolary.sources.shared import cut
from symbolary.sources.tables import table

BANDS, ROWS = 64, 8
BINS = BANDS * ROWS
SIMILARITY = 0.8
#: What a part of a bucket holds about: shingles and members.
PART_SHINGLES, PART_MEMBERS = 1 << 17, 512
#: Attempts of the densification before the next full bin upwards is taken.
ATTEMPTS = 200

_PICKS = (mix64(np.arange(1, ATTEMPTS * BINS + 1, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int32).reshape(ATTEMPTS, BINS)
_POWERS = np.array([power(i) for i in range(ROWS)])
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_set(text: str | bytes | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(hashes_of(text), size))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of the BANDS buckets of a set that is not empty."""
    at = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int32)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    value, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    value[at[first]], full[at[first]] = shingles[first], True
    if not full.all():
        empty = np.flatnonzero(~full)
        for picks in _PICKS:
            source = picks[empty]
            there = full[source]
            value[empty[there]] = value[source[there]]
            empty = empty[~there]
            if not len(empty):
                break
        else:
            bins = at[first]
            value[empty] = value[bins[np.searchsorted(bins, empty) % len(bins)]]
    return mix64((mix64(value).reshape(BANDS, ROWS) * _POWERS).sum(1, dtype=np.uint64) ^ _BAND)


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, key (of the text), n_shingles, digest (of the set; null if empty), bands."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for part, words, counts in hashed_texts(batch.column("text")):
                n, digests, bands, ends = [], [], [], [0]
                for own in np.split(words, np.cumsum(counts)[:-1]):
                    x = np.unique(shingle_hashes(own, size))
                    n.append(len(x))
                    digests.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                    if len(x):
                        bands.append(band_keys(x))
                    ends.append(ends[-1] + BANDS * bool(len(x)))
                flat = np.concatenate([*bands, np.empty(0, np.uint64)]).view(np.int64)
                cols = [batch.column(c)[part] for c in ("id", "key")]
                cols += [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (id, c) of which the full sets are similar enough. texts: id, packed, one row for each id."""
    tx, tc = texts.select(F.col("id").alias("i1"), F.col("packed").alias("x")), texts.select(F.col("id").alias("i2"), F.col("packed").alias("y"))
    both = pairs.join(tx, pairs.id == tx.i1).join(tc, pairs.c == tc.i2).select("id", "c", "x", "y")
    schema = T.StructType([pairs.schema["id"], pairs.schema["c"]])
    percent = round(100 * similarity)

    def run(batches):
        for batch in batches:
            linked, last, held = [], None, None
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                y = y.as_py()
                if last is None or y != last:
                    last, held = y, shingle_set(unpacked(y), size)
                own = shingle_set(unpacked(x.as_py()), size)
                low, high = sorted((len(own), len(held)))
                common = len(np.intersect1d(own, held, assume_unique=True)) if 100 * low >= percent * high else 0
                linked.append(100 * common >= percent * (low + high - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), batch.column("c").filter(keep)], names=schema.names)

    return both.mapInArrow(lean(run), schema)


def forest(sets: list[np.ndarray], side: np.ndarray, main: np.ndarray, within: bool, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (numbers) that connect all members that are linked, among pairs of sides 0 and 1 (or within side 0).

    Pairs of one label, and pairs that are both main, are not compared.
    """
    one = np.flatnonzero(side == 0)
    two = one if within else np.flatnonzero(side == 1)
    sizes = np.array([len(x) for x in sets])
    common = shared_counts([sets[i] for i in one], [sets[i] for i in two])
    linked = 100 * common >= percent * (sizes[one][:, None] + sizes[two][None, :] - common)
    linked &= label[one][:, None] != label[two][None, :]
    linked &= ~(main[one][:, None] & main[two][None, :])
    root, out = list(range(len(sets))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in zip(*np.nonzero(linked), strict=True):
        i, j = int(one[i]), int(two[j])
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _one_label(links_: DataFrame, members: DataFrame) -> DataFrame:
    """members and label: the least id within two links, so members of one label are linked (others may be, too)."""
    both = links_.select("id", "c").unionByName(links_.select(F.col("c").alias("id"), F.col("id").alias("c")))
    near = cut(both.groupBy("id").agg(F.min("c").alias("near")).select(F.col("id").alias("i"), F.least("i", "near").alias("near")))
    further = near.select(F.col("i").alias("j"), F.col("near").alias("further"))
    named = near.join(further, near.near == further.j, "left").select("i", F.coalesce("further", "near").alias("near"))
    return members.join(named, members.id == named.i, "left").withColumn("label", F.coalesce("near", "id")).drop("i", "near")


def _leftovers(members: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, id, label, main of the buckets in which two members may still be linked. members: bucket, id."""
    labelled = _one_label(found, members)
    tally = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    whole = tally.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max_by("label", F.struct("n", "label")).alias("commonest"))
    # buckets of the same members are one
    open_ = whole.where("n > 2 and labels > 1").groupBy("n", "x", "y").agg(F.min_by(F.struct("bucket", "commonest"), "bucket").alias("b")).select(F.col("b.bucket").alias("k"), F.col("b.commonest").alias("commonest"))
    return labelled.join(open_, labelled.bucket == open_.k).select("bucket", "id", "label", (F.col("label") == F.col("commonest")).alias("main"))


def _dealt(left: DataFrame) -> DataFrame:
    """left (bucket, id, label, main, n) with task (two parts of the bucket) and side: every part meets every other, mains no mains."""
    many = left.groupBy("bucket", "main").agg(F.ceil(F.greatest(F.sum("n") / PART_SHINGLES, F.count("*") / PART_MEMBERS)).cast("int").alias("parts"))
    parts = many.groupBy("bucket").agg(F.coalesce(F.sum(F.when(~F.col("main"), F.col("parts"))), F.lit(0)).cast("int").alias("others"), F.coalesce(F.sum(F.when(F.col("main"), F.col("parts"))), F.lit(0)).cast("int").alias("mains")).withColumnRenamed("bucket", "k")
    rows = left.join(parts, left.bucket == parts.k).drop("k")
    own = F.when(F.col("main"), F.col("others") + F.pmod(F.xxhash64("id", "bucket"), F.greatest("mains", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id", "bucket"), F.greatest("others", F.lit(1)))).cast("int")
    # a part of others meets all parts, one of mains those of the others
    meets = F.when(F.col("main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    rows = rows.withColumn("part", own).where("others > 0").withColumn("other", F.explode(meets))
    return rows.select("bucket", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), (F.col("part") > F.col("other")).cast("int").alias("side"), "id", "label", "main")


def _compare(left: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """id, c: links among left (bucket, id, label, main, n), compared in tasks of bounded size."""
    schema = T.StructType([texts.schema["id"], T.StructField("set", T.BinaryType())])

    def sets(batches):
        for batch in batches:
            found = [shingle_set(unpacked(x.as_py()), size).tobytes() for x in batch.column("packed")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=schema.names)

    named = left.select(F.col("id").alias("i")).distinct()
    held = texts.join(named, texts.id == named.i, "left_semi").mapInArrow(lean(sets), schema).select(F.col("id").alias("i"), "set")
    dealt = _dealt(left)
    tasks = dealt.join(held, dealt.id == held.i).drop("i").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    percent = round(100 * similarity)
    out = T.StructType([left.schema["id"], T.StructField("c", left.schema["id"].dataType)])

    def compare(rows: pa.Table) -> pa.RecordBatch:
        ids, label = rows.column("id").combine_chunks(), rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
        links_ = forest(sets, rows.column("side").to_numpy(), rows.column("main").to_numpy(), rows.column("a")[0] == rows.column("b")[0], label, percent)
        return pa.RecordBatch.from_arrays([ids.take(pa.array([i for i, _ in links_], pa.int64())), ids.take(pa.array([j for _, j in links_], pa.int64()))], names=out.names)

    def run(batches):
        for rows in by_task(batches, ("bucket", "a", "b")):
            yield compare(rows)

    return tasks.mapInArrow(lean(run), out)


def links(reps: DataFrame, texts: DataFrame, size: int, similarity: float = SIMILARITY) -> DataFrame:
    """id, c: confirmed links between class representatives, enough to connect all that are linked.

    reps: id, key, n_shingles, bands. texts: id, key, text of at least these.
    """
    rows = reps.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("id").alias("c"), F.max("id").alias("last")).where("c <> last").select(F.col("bucket").alias("k"), "c")
    members = cut(rows.join(shared, rows.bucket == shared.k).select("bucket", "id", "c"))
    # texts of candidates only; the largest table is shuffled once for this
    named = members.select("id").distinct().join(reps.select("id", "key"), "id")
    texts = cut(packed(texts.join(named, ["id", "key"], "left_semi").select("id", "text")).dropDuplicates(["id"]))
    found = cut(_confirm(members.where("id <> c").select("id", "c").distinct(), texts, size, similarity))
    left = cut(_leftovers(members.select("bucket", "id"), found).join(reps.select(F.col("id").alias("i"), F.col("n_shingles").alias("n")), F.col("id") == F.col("i")).drop("i"))
    return found.unionByName(cut(_compare(left, texts, size, similarity)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable), kept (whether it is the id itself): a row for each row."""
    base = cut(signatures(docs, size, id_col, text_col))
    full = base.where("digest is not null and id is not null")
    classes = full.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    # one row for each representative, though its row may be repeated
    first = full.join(classes.select(F.col("digest").alias("d"), "rep"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("rep")))
    reps = first.groupBy("id").agg(F.min_by(F.struct("key", "n_shingles", "bands"), "key").alias("r")).select("id", "r.*")
    edges = links(reps, docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("key"), docs[text_col].alias("text")), size, similarity)
    roots = components(edges, "id", "c")
    named = classes.join(roots, classes.rep == roots.vertex, "left").select(F.col("digest").alias("d"), F.coalesce("root", "rep").alias("component"))
    out = base.join(named, base.digest == named.d, "left")
    component = F.when(base.id.isNotNull(), F.coalesce("component", base.id))
    return out.select(base.id.alias(id_col), "n_shingles", component.alias("component_id"), (component == base.id).alias("kept"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by two-word shingles, as its contract has it."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


QUERIES = {"op4_minhash_dedup": op4_minhash_dedup}
ORACLES: dict[str, str] = {}
