"""SentencePiece encoding and decoding over tables of distinct chunks.

No piece of the model holds a white-space marker after another character, and none holds a line break, so the text may
be cut before each run of spaces and around each line break without changing its segmentation. Each task cuts its texts
in place (one offset array over the same bytes), segments every distinct chunk of a slice of SLICE_BYTES once, and joins
the ids back by position; nothing is shuffled. Decoding goes the other way: each id's bytes
are taken by id and joined per document.

Defined results: a null text has null ids and a null decoded text; an empty one has no ids; the text may be of any
length; ids are those of encoding each whole text at once. Decoding gives back the text, but that a literal U+2581 comes
back as a space. Repeated rows are encoded each. encode() appends token_ids and n_tokens, encode_checked() also
round_trip, and replaces columns of those names; all other columns pass through. An empty table gives an empty result.

The model's path is that of the driver; the file is sent to all workers.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import text as X

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that share one table of distinct chunks; a longer text has one of its own.
SLICE_BYTES = 4 << 20
#: Distinct chunks that the model sees at once, a line each.
LINES = 256
MARK = "▁"


class Codec:
    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        for i, p in enumerate(pieces):
            if not self.model.is_byte(i) and not self.model.is_control(i) and (MARK in p.lstrip(MARK) or "\n" in p):
                raise ValueError(f"piece {p!r} crosses a white-space marker or a line break: chunks can't be segmented alone")
        self.newline = self.model.piece_to_id("<0x0A>")
        raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        if self.model.is_unknown(self.model.unk_id()):
            raw[self.model.unk_id()] = " ⁇ ".encode()
        self.bytes = pa.array(raw, pa.binary())

    def _segment(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks and each one's offset among them.

        Chunks stand in lines of one text: a line break, which no piece holds, parts their ids again.
        """
        breaks = pc.equal(chunks, "\n").to_numpy(zero_copy_only=False)
        lines = pc.if_else(pa.array(breaks), "", chunks) if breaks.any() else chunks
        values, ends, base = [], [np.zeros(1, np.int64)], 0
        for at in range(0, len(lines), LINES):
            part = lines.slice(at, LINES)
            one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), "\n")[0].as_py()
            ids = np.array(self.model.encode("\n" + one + "\n", out_type=int), np.int32)
            parts = np.flatnonzero(ids == self.newline)
            ids = ids[parts[0] + 1 :]
            parts = parts[1:] - parts[0] - 1
            values.append(np.delete(ids, parts))
            ends.append(base + parts - np.arange(len(parts)))
            base = int(ends[-1][-1])
        values, off = np.concatenate(values), np.concatenate(ends)
        for k in np.flatnonzero(breaks):
            values = np.insert(values, off[k], self.newline)
            off[k + 1 :] += 1
        return values, off

    def encode(self, text: pa.Array) -> pa.Array:
        """The ids of each text, as lists of int32."""
        data, row = X.flat(text)
        # the model sees a text behind one more space
        length = np.diff(row)
        some = np.flatnonzero(length > 0)
        lead = np.zeros(len(length), np.int64)
        lead[some] = 1
        grown = np.insert(data, row[:-1][some], 32)
        row = row + np.concatenate(([0], np.cumsum(lead)))
        if not len(grown):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(row)), pa.int32()), pa.array([], pa.int32()))
        space, line = grown == 32, grown == 10
        marks = np.flatnonzero((grown[:-2] == 0xE2) & (grown[1:-1] == 0x96) & (grown[2:] == 0x81))
        for k in range(3):
            space[marks + k] = True
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut |= line
        cut[1:] |= line[:-1]
        cut[row[:-1][some]] = True
        begin = np.flatnonzero(cut)
        offsets = np.append(begin, len(grown)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(grown)))
        table = chunks.dictionary_encode()
        values, start = self._segment(table.dictionary)
        size = np.diff(start)
        code = table.indices.to_numpy()
        n = size[code]
        to = np.concatenate(([0], np.cumsum(n)))
        out = values[np.repeat(start[code] - to[:-1], n) + np.arange(to[-1])]
        return pa.ListArray.from_arrays(pa.array(to[np.searchsorted(begin, row)], pa.int32()), pa.array(out, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids."""
        off = ids.offsets.to_numpy()
        piece = self.bytes.take(ids.values)
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, piece), pa.scalar(b"", pa.binary()))
        data = np.frombuffer(joined.buffers()[2], np.uint8) if joined.buffers()[2] else np.zeros(0, np.uint8)
        row = np.frombuffer(joined.buffers()[1], np.int32)[: len(ids) + 1].astype(np.int64)
        first = row[:-1][np.diff(row) > 0]
        drop = first[data[first] == 32]  # the marker before the text
        keep = np.ones(row[-1], bool)
        keep[drop] = False
        text = data[: row[-1]][keep]
        row = row - np.searchsorted(drop, row)
        return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(row.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text)))


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def _sent(spark: SparkSession, model: str) -> str:
    """The name under which workers find the model, which is sent to them once."""
    sc = spark.sparkContext
    there = sc.__dict__.setdefault("_tessera_files", set())
    if model not in there:
        sc.addFile(model)
        there.add(model)
    return os.path.basename(model)


def _null_where(values: pa.Array, like: pa.Array) -> pa.Array:
    return values if not like.null_count else pc.if_else(pc.is_null(like), pa.scalar(None, values.type), values)


def _coded(text: pa.Array, path: str, decode: bool) -> Iterator[tuple[int, int, pa.Array, pa.Array | None]]:
    """(first row, row after the last, ids, decoded text or None), slice by slice."""
    c = codec(path)
    for a, b in X.slices(text, SLICE_BYTES):
        part = text.slice(a, b - a)
        ids = c.encode(part)
        yield a, b, _null_where(ids, part), _null_where(c.decode(ids), part) if decode else None


def encode(docs: DataFrame, model: str = MODEL, check: bool = False) -> DataFrame:
    """docs with token_ids array<int> and n_tokens int, and with check round_trip boolean; no shuffle."""
    added = ["token_ids", "n_tokens", *(["round_trip"] if check else [])]
    docs = docs.drop(*added)
    name = _sent(docs.sparkSession, model)
    at = docs.columns.index("text")
    kinds = [T.ArrayType(T.IntegerType()), T.IntegerType(), T.BooleanType()]
    schema = T.StructType([*docs.schema, *(T.StructField(n, k) for n, k in zip(added, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, back in _coded(batch.column(at), SparkFiles.get(name), check):
                part = batch.slice(a, b - a)
                new = [ids, pc.list_value_length(ids), *([pc.equal(back, part.column(at))] if check else [])]
                yield pa.record_batch([*part.columns, *new], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, schema)


def encode_checked(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with token_ids, n_tokens and round_trip: whether the ids decode to the text again."""
    return encode(docs, model, True)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with decoded string, the text of its token_ids."""
    encoded = encoded.drop("decoded")
    name = _sent(encoded.sparkSession, model)
    at = encoded.columns.index("token_ids")
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at)
            dense = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))), pa.int32()), ids.flatten())
            yield pa.record_batch([*batch.columns, _null_where(codec(SparkFiles.get(name)).decode(dense), ids)], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, token_ids, n_tokens, and whether the ids decode to the text again; both ways in one pass."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return encode(slim, model, True).drop("text")
