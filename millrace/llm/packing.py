"""Packing token pieces into sequences: plans on the length histogram, carried out as joins.

Only piece lengths matter to a packing, and they are whole numbers up to the capacity.
So a plan is worked out for the histogram of lengths (at most ``capacity`` rows,
whatever the corpus), treating the bins that look alike as one group with a count. A
group's slots are then runs of ranks within a length, and every piece finds its slot by
its rank in an equi-join on the length with a table of bounded size.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, salted_rank
from .tokens import cut, encoder, texts


@dataclass
class Bins:
    """``count`` bins alike: runs of (length, pieces of it per bin) and the room left in each."""

    count: int
    room: int
    runs: list[tuple[int, int]] = field(default_factory=list)

    def plus(self, count: int, length: int, pieces: int) -> "Bins":
        return Bins(count, self.room - length * pieces, [*self.runs, (length, pieces)])


class RoomTree:
    """Segment tree over the capacities 0..capacity: which is the least one >= s that some open bin has left?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.size)
        self.bins: dict[int, list[Bins]] = {}

    def add(self, bins: Bins) -> None:
        if bins.count:
            self.bins.setdefault(bins.room, []).append(bins)
            self._mark(bins.room, 1)

    def _mark(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.some[at] += by
            at >>= 1

    def take(self, least: int) -> Bins | None:
        """Remove and return the bins with the least room >= ``least``."""
        at = least + self.size
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.size
        self._mark(room, -1)
        return self.bins[room].pop()

    def all(self) -> list[Bins]:
        return [x for xs in self.bins.values() for x in xs]


def best_fit(tree: RoomTree, length: int, count: int, capacity: int) -> None:
    """Place ``count`` pieces of ``length``, each into the fullest bin that holds it, else a new one.

    A bin that still holds another piece of the same length stays the fullest one, so
    each bin takes as many as it can in a row.
    """
    while count:
        bins = tree.take(length) if length <= capacity else None
        if bins is None:
            bins = Bins(-(-count // (capacity // length)), capacity)
        each = bins.room // length
        full = min(bins.count, count // each)
        count -= full * each
        tree.add(bins.plus(full, length, each))
        left = bins.count - full
        if left and count:
            tree.add(bins.plus(1, length, count))
            count, left = 0, left - 1
        tree.add(Bins(left, bins.room, bins.runs))


def plan_best_fit_decreasing(lengths: dict[int, int], capacity: int) -> list[Bins]:
    """Best-fit-decreasing packing of a length histogram."""
    tree = RoomTree(capacity)
    for length in sorted(lengths, reverse=True):
        best_fit(tree, length, lengths[length], capacity)
    return tree.all()


def plan_large_pairs(lengths: dict[int, int], capacity: int) -> list[Bins]:
    """Large-item matching: pieces above a third of the capacity go at most two to a bin.

    From the longest down, each is matched with the longest other large piece that
    fits beside it. Then the smaller ones, longest first, best-fit into the gaps.
    """
    left = {k: n for k, n in lengths.items() if n}
    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    tree = RoomTree(capacity)
    for i, length in enumerate(large):
        for mate in large[i:]:
            if not left[length]:
                break
            if length + mate > capacity or not left[mate]:
                continue
            pairs = left[length] // 2 if mate == length else min(left[length], left[mate])
            left[length] -= pairs
            left[mate] -= pairs
            tree.add(Bins(pairs, capacity - length - mate, [(length, 2)] if mate == length else [(length, 1), (mate, 1)]))
        tree.add(Bins(left[length], capacity - length, [(length, 1)]))
        left[length] = 0
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        best_fit(tree, length, left[length], capacity)
    return tree.all()


def assign_slots(pieces: DataFrame, capacity: int, plan, order: list[str]) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (long column ``length``, 1..capacity) by ``plan``.

    The histogram (<= capacity rows) is all that reaches the driver; the slot table has
    a few rows per length and is broadcast, its size bounded by the capacity alone.
    """
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, used, first = [], dict.fromkeys(lengths, 0), 0
    for bins in plan(lengths, capacity):
        offset = 0
        for length, each in bins.runs:
            ranks = each * bins.count
            slots.append((length, used[length], used[length] + ranks, first, each, offset))
            used[length] += ranks
            offset += length * each
        first += bins.count
    spark = pieces.sparkSession
    table = spark.createDataFrame(slots, "slot_length long, rank_from long, rank_to long, first long, each long, at long")
    ranked = salted_rank(pieces, ["length"], order, "_rank")
    hit = (F.col("length") == F.col("slot_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))
    nth = F.col("_rank") - F.col("rank_from")
    return ranked.join(F.broadcast(table), hit).select(
        *pieces.columns,
        (F.col("first") + F.expr("(_rank - rank_from) div each")).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"),
    )


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and its closing ``end_id``."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches):
        enc = encoder(tokenizer)
        for ids, bodies in texts(batches):
            out = []
            for doc, text in zip(ids, bodies):
                data = enc.ids(text) + end
                for i, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    out.append((doc, i, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], [f.name for f in schema])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k", end_id: int = 0) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as large-item matching finds.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. A null or empty text is the closing id alone. Rows that repeat a doc_id, or
    a whole row, are packed each by itself; a null doc_id stays null. Only documents
    longer than the capacity are cut. An empty table gives no rows; further columns of
    ``docs`` are not read. Ties in length are broken by (doc_id, piece, ids_crc32).
    """
    pieces = materialize(token_pieces(docs, capacity, tokenizer, end_id), "pieces")
    return assign_slots(pieces, capacity, plan_large_pairs, ["doc_id", "piece", "ids_crc32"])
