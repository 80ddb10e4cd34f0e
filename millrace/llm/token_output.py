"""Packed token-id matrices: best-fit-decreasing packing, written as fixed-width id rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .packing import assign_slots, plan_best_fit_decreasing
from .tokens import cut, encoder, texts

_PIECE = "row long, doc_id long, piece int, start long, length long, ids binary"
_ROW = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


def packed_ids(ids: np.ndarray, pack) -> bytes:
    """Compressed little-endian ids, two bytes each where all of them fit, else four."""
    return pack(ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes())


def unpack_ids(blob: bytes, length: int) -> np.ndarray:
    """The ids of a piece of encoded_pieces."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(data, "<u2" if len(data) == 2 * length else "<u4")


def encoded_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """(row, doc_id, piece, start, length, ids): ids of each piece by itself, see packed_ids; row numbers the pieces.

    A row's number is its task's partition and its place there, so a table once written keeps it.
    """
    end = int(end_id).to_bytes(4, "little")
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def pieces(batches):
        enc, pack = encoder(tokenizer), zstandard.ZstdCompressor(level=1).compress
        row = TaskContext.get().partitionId() << 36
        for ids, bodies in texts(batches):
            out = []
            for doc, text in zip(ids, bodies):
                wide = np.frombuffer(enc.ids(text) + end, "<u4")
                for i, (start, length) in enumerate(cut(len(wide), capacity)):
                    out.append((row, doc, i, start, length, packed_ids(wide[start : start + length], pack)))
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in _PIECE.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, _PIECE)


def packed_matrix(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k", end_id: int = 0, pad_id: int = 0) -> DataFrame:
    """One row per packed sequence, with its whole row of the id matrix.

    sequence_id, n_tokens (without padding), doc_ids and pieces (of its segments, in
    place order), cu_seqlens (0, then each segment's end), position_resets (where
    position ids start again from 0), input_ids (``capacity`` little-endian uint32, the
    rest ``pad_id``). Every document's ids and its closing ``end_id`` occur once: the
    segments of one document, by piece, concatenate to it. A null or empty text is the
    closing id alone. Repeated rows are packed each by itself; a null doc_id stays null;
    an empty table gives no rows; further columns are not read. Each sequence gathers at
    most ``capacity`` segments, so no group is unbounded.
    """
    pieces = materialize(encoded_pieces(docs, capacity, tokenizer, end_id), "ids", "none")
    # the ids stay out of the ranking: slots join back on the number that the table holds
    small = pieces.select("row", "doc_id", "piece", "length", F.xxhash64("ids").alias("ids_hash"))
    slots = assign_slots(small, capacity, plan_best_fit_decreasing, ["doc_id", "piece", "ids_hash", "row"]).select("row", "sequence_id", "offset")
    placed = pieces.drop("start").join(slots, "row").select("sequence_id", F.struct("offset", "length", "doc_id", "piece", "ids").alias("segment"))
    grouped = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list("segment")).alias("segments"))
    schema = T._parse_datatype_string(_ROW)
    types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for seq, segments in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.full(capacity, pad_id, "<u4")
                    for s in segments:
                        ids[s["offset"] : s["offset"] + s["length"]] = unpack_ids(s["ids"], s["length"])
                    ends = [s["offset"] + s["length"] for s in segments]
                    out.append((seq, ends[-1], [s["doc_id"] for s in segments], [s["piece"] for s in segments], [0, *ends], [s["offset"] for s in segments], ids.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.name for f in schema])

    return grouped.mapInArrow(rows, schema)


def write_packed(matrix: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write packed_matrix rows as Parquet; each file holds whole rows of the id matrix, ordered by sequence_id."""
    matrix.sortWithinPartitions("sequence_id").write.mode(mode).option("compression", "zstd").parquet(path)
