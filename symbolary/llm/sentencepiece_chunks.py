"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model holds a white space marker after another character, no merge can cross
from a word into the next marker, so that a text's ids are the ids of its marked words one after
another. Each distinct marked word of a slice of texts is segmented once by the library; texts get
their ids, and what the ids decode to, by position from that table. Models for which this does not
hold (pieces across markers, a normaliser, no dummy prefix) encode whole texts.

No piece holds a line end either, so the words of a table are encoded many at a time, a line each.
Words, ids and digits of ids are runs of arrays; none of them becomes an object of its own.

Null and empty texts have no ids. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from symbolary.llm.common import bytes_of, lean, slices, small_batches
from symbolary.sources.tables import table

MODEL = "piece_bpe_32k.model"
#: Bytes of texts that share a table, and of chunks that the library gets at once.
TABLE_BYTES, LINES_BYTES = 1 << 21, 1 << 14

_MARK = "▁"


def _values(data: np.ndarray, ends: np.ndarray) -> pa.LargeStringArray:
    """The runs of bytes between neighbours of `ends`."""
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _bytes(values: pa.Array) -> np.ndarray:
    """The bytes of all values of an array that begins with its buffers."""
    data, ends = bytes_of(values)
    return data[: int(ends[-1])]


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(counts, dtype=np.int64)]


@dataclass(frozen=True)
class Encoded:
    """Of texts one after another: ids, ids as digits with a comma after each, decoded bytes; and where each text ends in them."""

    ids: np.ndarray
    id_ends: np.ndarray
    digits: np.ndarray
    digit_ends: np.ndarray
    decoded: np.ndarray
    decoded_ends: np.ndarray

    def digests(self) -> tuple[list[str], list[str]]:
        """SHA-256 of each text's ids joined by commas, and of what they decode to."""
        found = []
        for data, ends, tail in ((self.digits, self.digit_ends, 1), (self.decoded, self.decoded_ends, 0)):
            spans = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            found.append([hashlib.sha256(data[a : max(a, b - tail)]).hexdigest() for a, b in spans])
        return found[0], found[1]

    def texts(self) -> list[str]:
        """What each text decodes to."""
        return [self.decoded[a:b].tobytes().decode() for a, b in zip(self.decoded_ends, self.decoded_ends[1:])]


class ChunkTable:
    """The distinct chunks of texts by a model: number of ids, ids, digits of ids, decoded bytes."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.names = pa.array([f"{i}," for i in range(self.model.get_piece_size())], pa.large_string())
        self.by_chunk = self._splits()
        if self.by_chunk:
            self.blank, self.line = self.model.encode("\n")

    def _splits(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        spec, pieces = proto.normalizer_spec, [p.piece for p in proto.pieces if p.type != 6]
        plain = spec.name == "identity" and not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        own = any(p.type == 4 for p in proto.pieces) or proto.trainer_spec.treat_whitespace_as_suffix
        crossing = any(re.search("[^▁]▁|\n| ", p) for p in pieces)
        return plain and not own and not crossing and len(self.model.encode("\n")) == 2

    def _digits(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digits of ids, and where the runs of ids between neighbours of `ends` end in them."""
        named = self.names.take(pa.array(ids))
        return _bytes(named), bytes_of(named)[1][ends]

    def _lines(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and decoded bytes of chunks without a line end, and how many of each a chunk has.

        The library puts a marker before what it encodes. A line end comes first, whose two ids then go; each chunk has one
        behind it, which tells where its ids end.
        """
        ids, counts, decoded, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)], [np.empty(0, np.int64)]
        for part in slices(bytes_of(chunks)[1], LINES_BYTES):
            lines = "\n".join(chunks[part.start : part.stop].to_pylist())
            whole = self.model.encode(f"\n{lines}\n")
            found = np.array(whole, np.int32)
            text = np.frombuffer(self.model.decode(whole).encode(), np.uint8)
            at, stop = np.flatnonzero(found == self.line), np.flatnonzero(text == 10)
            if at[0] != 1 or not len(at) == len(stop) == part.stop - part.start + 1:
                raise ValueError(f"chunks of {lines[:40]!r} do not stand for themselves")
            ids.append(np.delete(found, np.r_[0, at]))
            counts.append(np.diff(at) - 1)
            decoded.append(text[text != 10])
            sizes.append(np.diff(stop) - 1)
        return np.concatenate(ids), np.concatenate(counts), np.concatenate(decoded), np.concatenate(sizes)

    def encode(self, column: pa.Array) -> Encoded:
        """The texts of a string column."""
        if not self.by_chunk:
            found = [self.model.encode(x or "") for x in column.to_pylist()]
            decoded = [x.encode() for x in self.model.decode(found)]
            ids, ends = np.array([i for x in found for i in x], np.int32), _ends([len(x) for x in found])
            return Encoded(ids, ends, *self._digits(ids, ends), np.frombuffer(b"".join(decoded), np.uint8), _ends([len(x) for x in decoded]))
        data, ends = bytes_of(column)
        if _MARK.encode() in data[ends[0] : ends[-1]].tobytes():
            data, ends = bytes_of(pc.replace_substring(column, _MARK, " "))
        # each text that has characters gets a blank, that of the marker which the library puts before it
        some = np.diff(ends) > 0
        data = np.insert(data[ends[0] : ends[-1]], (ends[:-1] - ends[0])[some], 32)
        ends = ends - ends[0] + _ends(some)
        # a chunk is a line end, or blanks and what follows them up to the next blank or line end
        blank, line = data == 32, data == 10
        begins = blank | line
        begins[1:] &= ~(blank[1:] & blank[:-1])
        begins[1:] |= line[:-1]
        begins[ends[:-1][some]] = True
        begins = np.flatnonzero(begins)
        table = _values(data, np.r_[begins, len(data)]).dictionary_encode()
        plain = pc.not_equal(table.dictionary, "\n").to_numpy(zero_copy_only=False)
        ids, counts, decoded, sizes = self._lines(table.dictionary.filter(pa.array(plain)))
        # the line end is the last chunk of the table
        number = np.where(plain, np.cumsum(plain) - 1, plain.sum())[table.indices.to_numpy()]
        ids, decoded = np.r_[ids, np.int32(self.line)], np.r_[decoded, np.uint8(10)]
        id_ends, sizes = _ends(np.r_[counts, 1]), np.r_[sizes, 1]
        of = np.searchsorted(begins, ends)
        digits, digit_ends = self._digits(ids, id_ends)
        at = pa.array(number)
        texts = []
        for run, stops in ((digits, digit_ends), (decoded, _ends(sizes))):
            placed = _values(run, stops).take(at)
            texts += [_bytes(placed), bytes_of(placed)[1][of]]
        digits, digit_ends, decoded, decoded_ends = texts
        # the library drops the blank of its marker
        drop = decoded_ends[:-1][some]
        decoded, decoded_ends = np.delete(decoded, drop), decoded_ends - _ends(some)
        flat = pa.LargeListArray.from_arrays(pa.array(id_ends), pa.array(ids)).take(at).flatten().to_numpy()
        return Encoded(flat, _ends(np.diff(id_ends)[number])[of], digits, digit_ends, decoded, decoded_ends)

    def rows(self, texts: list[str | None]) -> list[tuple[int, str, list[list[int]], str]]:
        """For each text: number of ids, ids joined by commas, ids, decoded text."""
        x = self.encode(pa.array(texts, pa.string()))
        ids = [x.ids[a:b].tolist() for a, b in zip(x.id_ends, x.id_ends[1:])]
        return [(len(i), ",".join(map(str, i)), [i], t) for i, t in zip(ids, x.texts(), strict=True)]


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(model_file: str) -> ChunkTable:
    """One table for each worker process and model."""
    if model_file not in _TABLES:
        _TABLES[model_file] = ChunkTable(model_file)
    return _TABLES[model_file]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, texts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, n_tokens, ids_sha256, decoded_sha256; with `ids` the ids, with `texts` the decoded text.

    One pass without a shuffle. The model file must be where each executor can open it.
    """
    small_batches(docs.sparkSession)
    fields = [docs.select(id_col, *keep).schema[c] for c in (id_col, *keep)]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("decoded", T.StringType())] * texts

    def run(batches):
        t = chunk_table(model_file)
        for batch in batches:
            column = batch.column("__text")
            for part in slices(bytes_of(column)[1], TABLE_BYTES):
                found = t.encode(column[part])
                out = [batch.column(c)[part.start : part.stop] for c in (id_col, *keep)]
                out += [pa.array(np.diff(found.id_ends)), *map(pa.array, found.digests())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(found.id_ends.astype(np.int32)), pa.array(found.ids)))
                if texts:
                    out.append(pa.array(found.texts()))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.select(id_col, *keep, docs[text_col].alias("__text")).mapInArrow(lean(run), T.StructType(fields))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLES: dict[str, str] = {}
