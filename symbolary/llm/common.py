"""What the text operators share: batches, word hashes and shingle hashes, on arrays of bytes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text characters that a Python worker holds at once, besides one whole text.
BATCH_CHARS = 500_000
#: Bytes of texts that are hashed at a time.
SLICE = 1 << 19

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the rows of an Arrow batch, as rows here hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def by_size(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[slice]:
    """Consecutive slices of at most `limit` characters each, or of one text."""
    start = held = 0
    for i, x in enumerate(texts):
        n = len(x or "")
        if i > start and held + n > limit:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


#: A value for each byte (that of the small letter for A-Z), and the powers of _STEP and their inverses by place.
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(_STEP, -1, 1 << 64))
        _POWERS[:] = [np.r_[np.uint64(1), np.cumprod(np.full(n, x, np.uint64))] for x in (np.uint64(_STEP), inverse)]
    return _POWERS[0], _POWERS[1]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, without a copy, and where each value begins and the last one ends; null is empty."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def _hash(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; marks: where texts begin."""
    n, space = len(data), _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[marks] = True
    edge[0] = edge[n] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    up, down = _powers(max(n, SLICE))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX2), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, A-Z lower-cased, in order, and how many words each text has.

    Words stand between ASCII white space. Works on arrays of SLICE bytes and a word at a time, so its memory doesn't
    depend on a text's length, and no word becomes an object.
    """
    at, end, hashes, starts = int(offsets[0]), int(offsets[-1]), [], []
    while at < end:
        stop = min(end, at + SLICE)
        while stop < end:
            blank = np.flatnonzero(_SPACE[data[at:stop]])
            if len(blank):
                stop = at + int(blank[-1]) + 1
                break
            stop = min(end, stop + SLICE)
        marks = offsets[(offsets >= at) & (offsets <= stop)] - at
        h, s = _hash(data[at:stop], marks)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), offsets))


def slices(offsets: np.ndarray, limit: int = 0) -> Iterator[slice]:
    """Consecutive slices of texts of at most `limit` bytes each (SLICE, if 0), or of one text."""
    limit, start = limit or SLICE, 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield slice(start, stop)
        start = stop


def hashed_texts(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, their word hashes and their numbers of words, slice by slice."""
    data, offsets = bytes_of(column)
    for part in slices(offsets):
        yield (part, *word_hashes(data, offsets[part.start : part.stop + 1]))


def hashes_of(text: str | bytes | None) -> np.ndarray:
    """The word hashes of one text, or of its bytes."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def lean(run):
    """The same over a partition's batches; then memory goes back to the system, as workers wait for other tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its memory
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def packed(rows: DataFrame) -> DataFrame:
    """id, packed: the texts (id, text) compressed, for tables that are kept and for joins that send texts around."""
    schema = T.StructType([rows.schema["id"], T.StructField("packed", T.BinaryType())])

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            found = [press.compress(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=schema.names)

    return rows.select("id", "text").mapInArrow(lean(run), schema)


def unpacked(x: bytes) -> bytes:
    return zstandard.decompress(x)


def power(k: int) -> np.uint64:
    return np.uint64(pow(_STEP, k, 1 << 64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, in order; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(n, size)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out += words[i : n - k + 1 + i] * power(i)
    return mix64(out + np.uint64(k * 0x632BE59BD9B4E019 & _MASK))


#: Columns of a table of sets by values.
COLUMNS = 4096


def shared_counts(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many values each of `rows` shares with each of `others`, all of them arrays without repeats.

    It is the product of two tables of sets by values, COLUMNS values at a time; values on one side only are left out.
    """
    out = np.zeros((len(rows), len(others)), np.float32)
    if not len(rows) or not len(others):
        return out
    sizes = [np.array([len(x) for x in side], np.int64) for side in (rows, others)]
    values, at = np.unique(np.concatenate([*rows, *others]), return_inverse=True)
    split = int(sizes[0].sum())
    there = np.zeros((2, len(values)), bool)
    there[0, at[:split]], there[1, at[split:]] = True, True
    both = there.all(0)
    number = np.cumsum(both) - 1
    placed = []
    for n, x in zip(sizes, (at[:split], at[split:]), strict=True):
        row = np.repeat(np.arange(len(n)), n)[both[x]]
        x = number[x[both[x]]]
        order = np.argsort(x, kind="stable")
        placed.append((row[order], x[order], len(n)))
    for begin in range(0, int(both.sum()), COLUMNS):
        tables = []
        for row, x, n in placed:
            lo, hi = np.searchsorted(x, [begin, begin + COLUMNS])
            table = np.zeros((n, min(COLUMNS, int(both.sum()) - begin)), np.float32)
            table[row[lo:hi], x[lo:hi] - begin] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def by_task(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each task, of batches that are sorted by the tasks' integer keys."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            now = tuple(key[:, lo])
            if kept and now != last:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept = []
            kept, last = [*kept, batch.slice(lo, hi - lo)], now
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()
