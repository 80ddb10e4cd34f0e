"""Phrase collocations: Misra-Gries summaries per hash partition find what may be frequent, a second pass counts it exactly."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import positions
from .common import materialize

#: A summary holds up to SLACK * mass / threshold counters, so it errs by less than threshold / SLACK.
SLACK = 4
#: Text bytes that one hash partition stands for; the number of partitions follows the corpus, from 2 ** 6 to 2 ** 20.
PART_BYTES = 1 << 21
#: Bits of the candidate filter that tasks of the second pass hold: one per FILTER_BYTES bytes of text, 2 ** 29 (64 MB) at most.
FILTER_BYTES = 8
MOST_FILTER_BITS = 29
#: Text bytes a task splits at a time, and phrase occurrences it counts before it hands its counts on.
LOT_BYTES = 1 << 19
LOT_PHRASES = 1 << 20

WORD, SPACE, BREAK = 0, 1, 2
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, 0x09]] = SPACE
CLASSES[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
#: Two odd multipliers of the words' polynomial hashes and the constants of a 64-bit finalizer.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64; those of a usual lot are kept."""
    usual = LOT_BYTES + (1 << 17)
    return _powers(base, usual)[:n] if n <= usual else _powers.__wrapped__(base, n)


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``data`` one behind the other, ``gap`` spaces after each, and where each begins."""
    to = np.cumsum(sizes + gap) - sizes - gap
    out = np.full(int(sizes.sum()) + gap * len(sizes), 0x20, np.uint8)
    inside = np.arange(int(sizes.sum())) + np.repeat(gap * np.arange(len(sizes)), sizes)
    out[inside] = data[inside + np.repeat(starts - to, sizes)]
    return out, to


class Lot:
    """The words of some texts, one space apart in one buffer: where they lie, their piece and text, and two hashes each."""

    def __init__(self, texts: list[bytes], groups: list[str], group_hashes: list[int]):
        self.groups = groups
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = CLASSES[raw]
        edge = np.diff((kind == WORD).view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.searchsorted(np.flatnonzero(kind == BREAK), starts).astype(np.int32)
        bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.text = np.searchsorted(bounds, starts, side="right").astype(np.int32)
        self.data, self.starts = gathered(raw, starts, ends - starts, 1)
        self.ends = self.starts + (ends - starts)
        self.salts = np.array(group_hashes, np.int64).view(np.uint64)
        self.words: dict[int, np.ndarray] = {}

    def word_hashes(self, which: int) -> np.ndarray:
        """Polynomial hashes of the words by differences of running sums, kept until ``words`` is cleared."""
        if which not in self.words:
            base, size = BASES[which], len(self.data)
            sums = np.zeros(size + 1, np.uint64)
            terms = self.data + np.uint64(1)
            terms *= powers(base, size)
            np.cumsum(terms, out=sums[1:])
            found = sums[self.ends] - sums[self.starts]
            found *= powers(pow(base, -1, 1 << 64), size)[self.starts]
            self.words[which] = mixed(found + (self.ends - self.starts).astype(np.uint64))
        return self.words[which]

    def places(self, n: int) -> np.ndarray:
        """First words of all runs of n words within a piece."""
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: max(0, len(self.piece) - n + 1)])

    def hashes(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """Hash of the n words from each place on, and of their group."""
        h, words = self.salts[self.text[at]] + np.uint64(n), self.word_hashes(which)
        for i in range(n):
            h = mixed(h * np.uint64(BASES[which]) + words[at + i])
        return h


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[Lot]:
    """The texts of Arrow batches of (grp, salt, text) in lots of LOT_BYTES or so, A to Z lowered."""
    for batch in batches:
        texts, groups, salts, size = [], [], [], 0
        for group, salt, text in zip(*batch.columns):
            texts.append((text.as_py() or b"").lower())
            groups.append(group.as_py())
            salts.append(salt.as_py())
            size += len(texts[-1]) + 1
            if size >= LOT_BYTES:
                yield Lot(texts, groups, salts)
                texts, groups, salts, size = [], [], [], 0
        if texts:
            yield Lot(texts, groups, salts)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries merge: add up equal keys; while over capacity, all counters lose as much as the largest that has no place.

    Each unit lost takes capacity + 1 units of the mass, so all merges of a partition
    together take less than mass / capacity from any one key, in whatever order.
    """
    keys, counts = added(keys, counts)
    if len(keys) <= capacity:
        return keys, counts, 0
    lost = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    kept = counts > lost
    return keys[kept], counts[kept] - lost, lost


def surviving(parts: list[tuple[np.ndarray, np.ndarray]], threshold: int) -> np.ndarray:
    """Keys whose count over all parts may reach the threshold: every one that does is among them."""
    mass = sum(int(c.sum()) for _, c in parts)
    capacity = SLACK * mass // threshold + 1
    keys, counts, lost = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    waiting, size = [], 0
    for i, (k, c) in enumerate(parts):
        waiting.append((k, c))
        size += len(k)
        if size >= capacity or i == len(parts) - 1:
            keys, counts, more = merged(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)]), capacity)
            waiting, size, lost = [], 0, lost + more
    return keys[counts + lost >= threshold]


def candidate_filter(rows: DataFrame, max_words: int, threshold: int, part_bits: int, filter_bits: int) -> np.ndarray:
    """A bit per value of the first ``filter_bits`` bits of a phrase's hash: set for every phrase that may reach the threshold.

    Tasks count the hashes of their own phrases and send each hash partition's counts
    as one row; a partition's task merges them into its Misra-Gries summary, reads the
    survivors and returns its stretch of the filter, so the driver gets no more than
    the filter. Within a partition phrases are told apart by 32 further bits; those
    that share all bits are counted as one, which can only add survivors.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            h = np.concatenate(waiting) >> np.uint64(32 - part_bits)
            waiting.clear()
            h.sort()
            once = np.flatnonzero(np.diff(h, prepend=~h[:1]))
            counts, h = np.diff(once, append=len(h)).astype("<u4"), h[once]
            part, keys = h >> np.uint64(32), h.astype("<u4")
            first = np.flatnonzero(np.diff(part, prepend=~part[:1]))
            cuts = list(zip(first, [*first[1:], len(part)]))
            blobs = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (keys, counts)]
            return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *blobs], ["part", "keys", "counts"])

        for lot in lots(batches):
            waiting += [lot.hashes(lot.places(n), n) for n in range(1, max_words + 1)]
            if sum(map(len, waiting)) >= LOT_PHRASES:
                yield sent()
        if sum(map(len, waiting)):
            yield sent()

    def stretch(table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(k.as_py(), "<u4").astype(np.uint64), np.frombuffer(c.as_py(), "<u4").astype(np.int64)) for k, c in zip(table["keys"], table["counts"])]
        bits = np.zeros(1 << (filter_bits - part_bits), np.uint8)
        bits[(surviving(parts, threshold) >> np.uint64(32 + part_bits - filter_bits)).astype(np.int64)] = 1
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    found = rows.mapInArrow(summaries, "part int, keys binary, counts binary").groupBy("part").applyInArrow(stretch, "part int, bits binary")
    out, width = np.zeros(1 << (filter_bits - 3), np.uint8), 1 << (filter_bits - part_bits - 3)
    for r in found.collect():  # 2 ** (filter_bits - 3) bytes in all
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


def phrase_counts(docs: DataFrame, max_words: int = 3, threshold: int = 10, group: str = "lang", text: str = "text") -> DataFrame:
    """(grp, phrase, n_words, f): all phrases of 1 to ``max_words`` words with f >= threshold, and per group all its words as phrase ''.

    A first pass (candidate_filter) leaves a filter that passes every such phrase. In the
    second, tasks count those occurrences that pass and the counts of equal phrases are
    added up, compared as strings. So a filter that passes too much, as one of bounded
    size must on a huge corpus, costs time but never changes a count. Within a task
    phrases are told apart by two 64-bit hashes.
    """
    spark = docs.sparkSession
    grp = F.coalesce(F.col(group).cast("string"), F.lit("und"))
    rows = docs.select(grp.alias("grp"), F.xxhash64(grp).alias("salt"), F.col(text).cast("string").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = min(20, max(6, (size // PART_BYTES).bit_length()))
    filter_bits = min(MOST_FILTER_BITS, max(part_bits + 9, (size // FILTER_BYTES).bit_length()))
    held = spark.sparkContext.broadcast(candidate_filter(rows, max_words, threshold, part_bits, filter_bits))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, waiting = held.value, []

        def counted() -> Iterator[pa.RecordBatch]:
            totals: Counter[str] = Counter()
            for lot, _ in waiting:
                for group, k in zip(lot.groups, np.bincount(lot.text, minlength=len(lot.groups)).tolist()):
                    totals[group] += k
            yield batch_of(pa.array(list(totals)), pa.array([""] * len(totals)), 0, np.array(list(totals.values())))
            names = {group: i for i, group in enumerate(totals)}
            data = np.concatenate([lot.data for lot, _ in waiting])
            bases = np.cumsum([0, *(len(lot.data) for lot, _ in waiting)])
            for n in range(1, max_words + 1):
                parts = []
                for base, (lot, found) in zip(bases, waiting):
                    at, *hashes = found[n]
                    of = np.array([names[g] for g in lot.groups], np.int32)[lot.text[at]]
                    parts.append((base + lot.starts[at], base + lot.ends[at + (n - 1)], of, *hashes))
                starts, ends, of, h, again = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(h)
                apart = np.diff(h[order]) != 0
                if np.any(~apart & (np.diff(again[order]) != 0)):
                    order = np.lexsort((again, h))
                    apart = (np.diff(h[order]) != 0) | (np.diff(again[order]) != 0)
                first = np.flatnonzero(np.concatenate([[True], apart])) if len(order) else order
                one = order[first]
                text, to = gathered(data, starts[one], ends[one] - starts[one])
                offsets = np.append(to, len(text)).astype(np.int32)
                phrase = pa.StringArray.from_buffers(len(one), pa.py_buffer(offsets), pa.py_buffer(text))
                yield batch_of(pa.array(list(names)).take(pa.array(of[one])), phrase, n, np.diff(np.append(first, len(order))))

        def batch_of(group: pa.Array, phrase: pa.Array, n: int, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([group, phrase, pa.array(np.full(len(phrase), n, np.int32)), pa.array(counts.astype(np.int64))], ["grp", "phrase", "n_words", "f"])

        for lot in lots(batches):
            found = {}
            for n in range(1, max_words + 1):
                places = lot.places(n).astype(np.int32)
                hashes = lot.hashes(places, n)
                spot = hashes >> np.uint64(64 - filter_bits)
                passed = (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                found[n] = places[passed], hashes[passed], lot.hashes(places[passed], n, 1)
            lot.words.clear()
            waiting.append((lot, found))
            if sum(len(at) for _, found in waiting for at, *_ in found.values()) >= LOT_PHRASES or len(waiting) >= 16:
                yield from counted()
                waiting.clear()
        if waiting:
            yield from counted()

    found = rows.mapInArrow(exact, "grp string, phrase string, n_words int, f long").groupBy("grp", "phrase", "n_words").agg(F.sum("f").alias("f"))
    return found.where((F.col("f") >= threshold) | (F.col("n_words") == 0))


def _runs(m: int) -> Column:
    """All runs of m words of the array w, space-joined."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (m - 1))), lambda i: F.concat_ws(" ", F.slice("w", i, m)))


def collocations(docs: DataFrame, max_words: int = 3, threshold: int = 10, top: int = 2000, swallowed: int = 50, group: str = "lang", text: str = "text") -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of each group by how much likelier they are than their parts.

    Words are runs of anything but space and tab within pieces that end at ``.,;:!?``
    and line ends, A to Z lowered. Of a phrase with a = f(phrase) >= threshold each cut
    into a first part (l times) and a rest (r times) scores floor(10^6 a a / (l r)); the
    lowest counts, of ties the shortest first part. A phrase goes where a longer one
    that holds it occurs at least ``swallowed`` % as often. Returns (group column, rank,
    phrase, a, l, r, n, score), n being the group's words.

    A null text is empty, a null group is ``und``; repeated rows count each time; ties
    rank by a, then phrase; an empty table gives no rows; other columns aren't read.
    Parts of a phrase are at least as frequent, so their counts stand in the same table.
    Ranks are places in sorted ranges (positions), so no group is one task.
    """
    counts = materialize(phrase_counts(docs, max_words, threshold, group, text), "phrases")
    found = counts.where("n_words > 1").select("grp", "phrase", "n_words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda start, size: F.concat_ws(" ", F.slice("w", start, size))
    cut = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    cuts = found.select("*", cut).select("grp", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    part = lambda side, f: counts.where("n_words > 0").select("grp", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["grp", "left"]).join(part("right", "r"), ["grp", "right"])
    # 38 digits hold 10^6 a a up to a = 10^16
    score = F.expr("(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.select("grp", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("grp", "phrase", "a").agg(F.min("cut").alias("cut"))
    kept = scored
    if max_words > 2:
        within = F.flatten(F.array(*[F.when(F.col("n_words") > m, _runs(m)).otherwise(F.array().cast("array<string>")) for m in range(2, max_words)]))
        longer = found.select("grp", "a", F.explode(within).alias("phrase")).groupBy("grp", "phrase").agg(F.max("a").alias("longest"))
        kept = scored.join(longer, ["grp", "phrase"], "left").where(F.coalesce(100 * F.col("longest") < swallowed * F.col("a"), F.lit(True)))
    told = kept.select("grp", "phrase", "a", "cut.l", "cut.r", "cut.score", (-F.col("cut.score")).alias("_s"), (-F.col("a")).alias("_a"))
    ranked = positions(told, ["grp"], ["_s", "_a", "phrase"], "rank").where(F.col("rank") < top)
    totals = counts.where("n_words = 0").select("grp", F.col("f").alias("n"))
    return ranked.join(totals, "grp").select(F.col("grp").alias(group), (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
