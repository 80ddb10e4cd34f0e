"""Fuzzy line dedup: MinHash bands over character shingles, exact Jaccard, union-find, one line per component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, join_common, materialize, release
from .components import connected_components

SHINGLE, BANDS, PER_BAND = 5, 20, 5
#: Buckets up to this size are paired by a join where pairs remain; larger ones meet block by block.
SMALL_BUCKET, BLOCK_LINES = 32, 512
#: Code points signed at once, so that the hashes stay in a core's cache.
CHUNK = 1 << 16
#: Lines whose bands a task remembers to have made; it starts afresh beyond that.
SEEN_LINES = 1_000_000
#: Candidate lines up to this number are broadcast (8 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 2_000_000
#: MinHash values of which a line's sketch holds four bits each, 16 a long, and how many standard errors a pair's matches may fall short.
SKETCHED, SHORT = 96, 5.5
SKETCH = [f"s{i}" for i in range(SKETCHED // 16)]
#: Bytes of a band key.
BAND_BYTES = 6
#: (line, band) pairs that a task packs at a time, and that one range of bands holds or so.
PACKED_PAIRS, RANGE_PAIRS = 1 << 20, 1 << 19
#: Rows of small buckets that a task pairs at a time, or so.
PAIRED_ROWS = 1 << 15
_ODD = np.random.default_rng(20).integers(1, 1 << 31, (2, BANDS * PER_BAND), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FOLD = np.random.default_rng(21).integers(1, 1 << 62, PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_values(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of every run of SHINGLE code points."""
    n = len(codes) - SHINGLE + 1
    h = np.zeros(n, np.uint32)
    for i in range(SHINGLE):
        h *= np.uint32(0x01000193)
        h ^= codes[i : i + n]
        h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    return h


def minima(text: str, spans: list[tuple[int, int]]):
    """The MinHash values, one array over the lines at ``spans`` of a text per hash; a line has SHINGLE code points at least."""
    h = shingle_values(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    # from, to, from, to, ...: every second reduction is a line's
    edges = np.array([x for a, b in spans for x in (a, b - SHINGLE + 1)])
    h = np.append(h, np.uint32(0xFFFFFFFF))
    mixed = np.empty_like(h)
    for k in range(BANDS * PER_BAND):
        np.bitwise_xor(h, _ODD[0, k], out=mixed)
        np.multiply(mixed, _ODD[1, k], out=mixed)
        yield np.minimum.reduceat(mixed, edges)[::2]


def band_keys(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """48-bit band keys (len(spans) x BANDS) and sketches (len(spans) x SKETCHED / 16) of the lines at ``spans`` of a text."""
    least = np.array(list(minima(text, spans)))
    return (folded(least, BANDS) >> np.uint64(16)).astype(np.int64), sketched(least)


def sketched(least: np.ndarray) -> np.ndarray:
    """Four bits of each of the first SKETCHED MinHash values (hashes x items), as longs (items x SKETCHED / 16)."""
    nibbles = (least[:SKETCHED] * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint64).reshape(SKETCHED // 16, 16, -1)
    shifts = np.arange(0, 64, 4, dtype=np.uint64)[None, :, None]
    return np.bitwise_or.reduce(nibbles << shifts, axis=1).T.view(np.int64)


def least_matches(threshold: float) -> float:
    """How many of the SKETCHED values of two texts of similarity ``threshold`` agree in four bits, less SHORT standard errors."""
    p = threshold + (1 - threshold) / 16
    return SKETCHED * p - SHORT * (SKETCHED * p * (1 - p)) ** 0.5


def matches_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many values the sketches a[i] and b[i] agree."""
    x = (a ^ b).view(np.uint64)
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return SKETCHED - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches (line, s0, s1, ...) agree nearly as often as those of texts of similarity ``threshold`` do.

    Four bits agree by chance one time in 16. A pair of just that similarity is lost if
    its matches fall SHORT standard errors below what is expected: one in ten million.
    """
    least = least_matches(threshold)
    both, held = pairs, [c for c in sketches.columns if c != "line"]
    for side in "ab":
        both = both.join(sketches.select(F.col("line").alias(side), *[F.col(c).alias(side + c) for c in held]), side)
    matches = F.lit(SKETCHED)
    for c in held:
        x = F.col("a" + c).bitwiseXOR(F.col("b" + c))
        any_ = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        matches -= F.bit_count(any_.bitwiseAND(F.lit(0x1111111111111111)))
    return both.where(matches >= least).select("a", "b")


def folded(least: np.ndarray, bands: int) -> np.ndarray:
    """Keys (items x bands) of MinHash values (bands * PER_BAND x items)."""
    least = least.reshape(bands, PER_BAND, -1)
    keys = np.zeros((bands, least.shape[2]), np.uint64)
    for nth in range(PER_BAND):
        keys = (keys ^ least[:, nth]) * _FOLD[nth]
        keys ^= keys >> np.uint64(29)
    return (keys + np.arange(bands, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)).T


def line_rows(text: str) -> list[tuple[int, int, int, int]]:
    """(number, XXH64 of the text, from, to) of every line that holds anything but white space."""
    at, found = 0, []
    for i, line in enumerate(text.split("\n")):
        if line and not line.isspace():
            found.append((i, xxhash.xxh64_intdigest(line.encode(), 42), at, at + len(line)))
        at += len(line) + 1
    return found


class Signer:
    """Gathers the lines of documents into (doc, doc_key, line_no, line, bands, s0, s1, ...) batches.

    bands (BAND_BYTES each) and the sketch s0, s1, ... are null for lines of fewer than SHINGLE code points, and for a line that this
    task has signed before, so a common line has at most about one set of bands a task.
    """

    def __init__(self, doc_type: pa.DataType):
        self.doc_type, self.seen = doc_type, set()
        self.clear()

    def clear(self) -> None:
        self.docs, self.keys, self.no, self.line, self.signed, self.bands, self.sketches = [], [], [], [], [], [], []
        self.pending, self.spans, self.length = [], [], 0

    def add(self, doc, key: int, text: str) -> None:
        for i, h, a, b in line_rows(text):
            self.docs.append(doc)
            self.keys.append(key)
            self.no.append(i)
            self.line.append(h)
            self.signed.append(b - a >= SHINGLE and h not in self.seen)
            if self.signed[-1]:
                self.seen.add(h)
                self.spans.append((a + self.length, b + self.length))
        self.pending.append(text)
        self.length += len(text) + 1
        if self.length >= CHUNK:
            self.sign()
        if len(self.seen) > SEEN_LINES:
            self.seen.clear()

    def sign(self) -> None:
        if self.spans:
            bands, sketches = band_keys("\n".join(self.pending), self.spans)
            self.bands.append(bands)
            self.sketches.append(sketches)
        self.pending, self.spans, self.length = [], [], 0

    def batch(self) -> pa.RecordBatch:
        self.sign()
        signed = np.array(self.signed, bool)

        keys = np.concatenate(self.bands) if self.bands else np.zeros((0, BANDS), np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.where(signed, BANDS * BAND_BYTES, 0))]).astype(np.int32)
        held = np.ascontiguousarray(keys.astype("<i8", order="C").ravel().view(np.uint8).reshape(-1, 8)[:, :BAND_BYTES])
        bands = pa.Array.from_buffers(pa.binary(), len(signed), [pa.py_buffer(np.packbits(signed, bitorder="little")), pa.py_buffer(offsets), pa.py_buffer(held)])
        sketches = np.zeros((len(signed), SKETCHED // 16), np.int64)
        if self.sketches:
            sketches[signed] = np.concatenate(self.sketches)
        cols = [pa.array(self.docs, self.doc_type), pa.array(self.keys, pa.int64()), pa.array(self.no, pa.int32()), pa.array(np.array(self.line, np.uint64).view(np.int64)), bands, *[pa.array(c, mask=~signed) for c in sketches.T.copy()]]
        self.clear()
        return pa.RecordBatch.from_arrays(cols, ["doc", "doc_key", "line_no", "line", "bands", *SKETCH])


def signed_lines(docs: DataFrame) -> DataFrame:
    """(doc, doc_key, line_no, line, bands, s0, s1, ...) of all lines of ``docs`` (doc, doc_key, text); line is the XXH64 of its text."""

    def run(batches):
        signer = None
        for batch in batches:
            signer = signer or Signer(batch.schema.field(0).type)
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    signer.add(doc, key, text)
                if len(signer.line) >= 20_000:
                    yield signer.batch()
            if signer.line:
                yield signer.batch()

    rows = docs.select("doc", "doc_key", "text")
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), *T._parse_datatype_string("doc_key long, line_no int, line long, bands binary, " + ", ".join(f"{c} long" for c in SKETCH)).fields])
    return rows.mapInArrow(run, schema)


def shingles(text: str) -> set[str]:
    return {text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))}


def alike(of_a: set, of_b: set, threshold: float) -> bool:
    """Whether two sets have a Jaccard similarity of ``threshold`` or more."""
    both = len(of_a & of_b)
    return both >= threshold * (len(of_a) + len(of_b) - both)


def packed_shingles(texts: list[str]) -> list[np.ndarray] | None:
    """The distinct shingles of each text (SHINGLE code points or more) as sorted numbers, alike across the texts; None beyond 4,096 different letters."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(int(codes.max()) + 1, bool)
    used[codes] = True
    if used.sum() > 1 << 12:
        return None
    places = (np.cumsum(used) - 1)[codes].astype(np.uint64)
    packed = np.zeros(len(places) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        packed = (packed << np.uint64(12)) | places[i : i + len(packed)]
    out, at = [], 0
    for text in texts:
        own = np.sort(packed[at : at + len(text) - SHINGLE + 1])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        at += len(text)
    return out


def similar_pairs(a: np.ndarray, b: np.ndarray, texts: list[str], threshold: float) -> np.ndarray:
    """Whether texts[a[i]] and texts[b[i]] have a Jaccard similarity of ``threshold`` or more, for every i; texts have SHINGLE code points or more."""
    own = packed_shingles(texts)
    if own is None:
        sets = [shingles(x) for x in texts]
        return np.array([alike(sets[x], sets[y], threshold) for x, y in zip(a.tolist(), b.tolist())])
    counts = np.array([len(x) for x in own])
    fits = np.minimum(counts[a], counts[b]) >= threshold * np.maximum(counts[a], counts[b])
    out = np.zeros(len(a), bool)
    for i in np.flatnonzero(fits).tolist():
        both = np.concatenate([own[a[i]], own[b[i]]])
        both.sort(kind="stable")
        n = np.count_nonzero(both[1:] == both[:-1])
        out[i] = n >= threshold * (len(both) - n)
    return out


def verified(pairs: DataFrame, line_texts: DataFrame, threshold: float, parts=None) -> DataFrame:
    """The pairs (a, b) whose texts' sets of ``parts`` (None: character shingles) have an exact Jaccard similarity of ``threshold`` or more."""
    of_a, of_b = line_texts.select(F.col("line").alias("a"), F.col("body").alias("text_a")), line_texts.select(F.col("line").alias("b"), F.col("body").alias("text_b"))
    joined = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "text_a", "text_b")

    def by_sets(batch: pa.RecordBatch) -> list[bool]:
        keep, last, own = [], None, set()
        for y, s, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if y != last:  # the join leaves the pairs of a line together
                last, own = y, parts(t)
            keep.append(alike(own, parts(s), threshold))
        return keep

    def by_shingles(batch: pa.RecordBatch) -> np.ndarray:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        lines, first, at = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
        both = pa.chunked_array([batch.column(2), batch.column(3)]).take(pa.array(first)).to_pylist()
        return similar_pairs(at[: len(a)], at[len(a) :], both, threshold)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                keep = by_shingles(part) if parts is None else by_sets(part)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, body) for the given lines, one row each. ``lines`` is broadcast only while it is known to be small."""
    each = docs.select(F.explode(F.split("text", "\n")).alias("body")).withColumn("line", F.xxhash64("body"))
    few = lines.count() <= BROADCAST_ROWS
    found = each.join(F.broadcast(lines) if few else lines, "line", "left_semi")
    return materialize(found.groupBy("line").agg(F.min("body").alias("body")), "bodies")


def shared_bands(signed: DataFrame) -> DataFrame:
    """Members (line, band, before, least, n), once each, of the bands that two different lines or more have: all that can lead to a pair.

    ``before`` is the line before among those of the band (null for the first), ``least``
    the first and ``n`` their number. Most lines share no band, so (line, band) pairs
    travel packed: a task sorts those of PACKED_PAIRS or so by range of bands and sends
    each range of bands as one row of two arrays, with 32 bits of a band beyond its
    range; a range's task puts them together and keeps what has a neighbour. The number of
    ranges follows the number of lines, some RANGE_PAIRS pairs each, so unlike bands that
    agree in all bits sent stay below one in some thousands; such lines are compared in vain.
    """
    rows = signed.where("bands is not null").select("line", "bands")
    pairs = signed.where("s0 is not null").count() * BANDS
    bits = min(8 * BAND_BYTES - 32, max(6, (pairs // RANGE_PAIRS).bit_length()))

    def packed(batches):
        lines, bands, size = [], [], 0

        def rows_of() -> pa.RecordBatch:
            band, line = np.concatenate(bands), np.concatenate(lines)
            # radix sort: a range's number has 16 bits
            part = (band >> np.uint64(8 * BAND_BYTES - bits)).astype(np.uint16)
            by = np.argsort(part, kind="stable")
            band, line, part = (band >> np.uint64(8 * BAND_BYTES - 32 - bits)).astype("<u4")[by], line[by], part[by]
            first = np.flatnonzero(np.diff(part.astype(np.int32), prepend=-1))
            cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(part)]))
            blobs = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (band, line)]
            return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *blobs], ["part", "bands", "lines"])

        for batch in batches:
            raw = np.zeros((batch.num_rows * BANDS, 8), np.uint8)
            raw[:, :BAND_BYTES] = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BAND_BYTES)
            lines.append(np.repeat(batch.column(0).to_numpy(), BANDS))
            bands.append(raw.view("<u8").ravel())
            size += len(bands[-1])
            if size >= PACKED_PAIRS:
                yield rows_of()
                lines, bands, size = [], [], 0
        if size:
            yield rows_of()

    def shared(t: pa.Table) -> pa.Table:
        band, line = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in t[c]]) for c, kind in (("bands", "<u4"), ("lines", "<i8")))
        by = np.argsort(band)
        band, line = band[by], line[by]
        # what is alone with its band goes before lines are put in order
        new = np.append(True, band[1:] != band[:-1])
        some = ~new | ~np.append(new[1:], True)
        band, line = band[some], line[some]
        by = np.lexsort((line, band))
        band, line = band[by], line[by]
        own = np.append(True, (band[1:] != band[:-1]) | (line[1:] != line[:-1]))[: len(band)]
        band, line = band[own], line[own]
        first = np.flatnonzero(np.append(True, band[1:] != band[:-1])[: len(band)])
        n = np.diff(first, append=len(band))
        sizes, least = np.repeat(n, n), np.repeat(line[first], n)
        starts = np.zeros(len(band), bool)
        starts[first] = True
        before = pa.array(np.concatenate([line[:1], line[:-1]]), mask=starts)
        whole = band.astype(np.int64) | np.int64(t["part"][0].as_py() << 32)
        found = pa.table([pa.array(line), pa.array(whole), before, pa.array(least), pa.array(sizes.astype(np.int32))], ["line", "band", "before", "least", "n"])
        return found.filter(pa.array(sizes > 1))

    return rows.mapInArrow(packed, "part int, bands binary, lines binary").groupBy("part").applyInArrow(shared, "line long, band long, before long, least long, n int")


def members_of(banded: DataFrame) -> DataFrame:
    """Members (line, band, before, least, n) of the bands of (line, band), repeats allowed, that two different lines or more have; see shared_bands."""
    by = Window.partitionBy("band").orderBy("line")
    placed = banded.withColumn("before", F.lag("line").over(by)).withColumn("least", F.first("line").over(by))
    new = F.col("before").isNull() | (F.col("before") != F.col("line"))
    return placed.withColumn("n", F.sum(new.cast("int")).over(Window.partitionBy("band")).cast("int")).where(new & (F.col("n") > 1)).select("line", "band", "before", "least", "n")


def line_components(docs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """(node, root) over the lines that have a near copy; see dedup_lines."""
    sketches = signed.where("s0 is not null").select("line", *SKETCH)
    return bucket_components(materialize(shared_bands(signed), "buckets"), lambda few: texts_of(docs, few), threshold, sketches=sketches)


def banded_components(banded: DataFrame, texts_for, threshold: float, parts=None, more_pairs: DataFrame | None = None) -> DataFrame:
    """(node, root) of the texts that have a near copy among those of one ``band``; ``banded`` has (line, band), repeats allowed."""
    return bucket_components(materialize(members_of(banded), "buckets"), texts_for, threshold, parts, more_pairs)


def bucket_components(members: DataFrame, texts_for, threshold: float, parts=None, more_pairs: DataFrame | None = None, sketches: DataFrame | None = None) -> DataFrame:
    """(node, root) of the texts that have a near copy in one of their buckets.

    ``members`` is a written table of shared_bands or members_of, ``texts_for`` gives
    (line, body) of a table of lines. ``more_pairs`` are further candidates (a, b) to
    verify. With ``sketches`` (line, s0, s1, ...; repeats allowed) pairs that these show to
    be unlike are not looked at further.
    """
    spark = members.sparkSession
    release(spark)
    # all pairs of a bucket of two or three are tried at once
    deep = members.where("n > 3").select("band", "line")
    tried = members.where("before is not null").select(F.col("least").alias("a"), F.col("line").alias("b")).union(members.where("before <> least").select("before", "line"))
    if more_pairs is not None:
        tried = tried.union(more_pairs.select("a", "b"))
    tried = tried.distinct()
    held = []
    if sketches is not None:
        held = [c for c in sketches.columns if c != "line"]
        wanted = materialize(members.select("line").distinct(), "candidates")
        sketches = materialize(sketches.join(wanted, "line", "left_semi").groupBy("line").agg(*[F.max(c).alias(c) for c in held]), "sketches")
        discard(wanted)
        tried = likely(tried, sketches, threshold)
    tried = materialize(tried, "pairs")
    release(spark)
    candidates = materialize(deep.select("line").union(tried.select("a")).union(tried.select("b")).distinct(), "candidates")
    bodies = texts_for(candidates)
    links = materialize(verified(tried, bodies, threshold, parts), "links")
    release(spark)
    roots = connected_components(links)
    # what is left: pairs of one bucket that no path joins yet and that were not tried
    placed = deep.join(roots, deep.line == roots.node, "left").select("band", "line", F.coalesce("root", "line").alias("comp")).repartition("band")
    bucket = Window.partitionBy("band")
    sized = placed.withColumns({"n": F.count(F.lit(1)).over(bucket), "lo": F.min("comp").over(bucket), "hi": F.max("comp").over(bucket)})
    open_ = materialize(sized.where("lo <> hi").select("band", "line", "comp", "n"), "open")
    discard(members, links)
    release(spark)
    rest = bucket_pairs(open_.where(F.col("n") <= SMALL_BUCKET), threshold, sketches).distinct().join(tried, ["a", "b"], "left_anti")
    blocks = block_links(open_.where(F.col("n") > SMALL_BUCKET), bodies, threshold, parts, sketches)
    more = materialize(verified(rest, bodies, threshold, parts).union(blocks), "links")
    discard(open_, tried, candidates, bodies, *[sketches] * bool(held))
    release(spark)
    return roots if more.isEmpty() else joined_roots(roots, more)


def bucket_pairs(members: DataFrame, threshold: float, sketches: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of lines of different components in the small buckets ``members`` (band, line, comp, n), repeats among them; with ``sketches`` those that may be alike (see likely).

    Buckets are dealt by band in parts of some PAIRED_ROWS rows, and a part is shifted against itself.
    """
    held = [] if sketches is None else [c for c in sketches.columns if c != "line"]
    parts = max(256, members.count() // PAIRED_ROWS)
    with_sketch = members if sketches is None else members.join(sketches, "line")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("band")
        band, line, comp = (t[c].to_numpy() for c in ("band", "line", "comp"))
        sketch = np.column_stack([t[c].to_numpy() for c in held]) if held else None
        found = [np.zeros((0, 2), np.int64)]
        for step in range(1, SMALL_BUCKET):
            x = np.flatnonzero((band[step:] == band[:-step]) & (comp[step:] != comp[:-step]))
            if sketch is not None:
                x = x[matches_of(sketch[x], sketch[x + step]) >= least_matches(threshold)]
            found.append(np.sort(np.stack([line[x], line[x + step]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table([pa.array(pairs[:, i]) for i in (0, 1)], ["a", "b"])

    dealt = with_sketch.select(F.pmod(F.xxhash64("band"), F.lit(parts)).alias("part"), "band", "line", "comp", *held)
    return dealt.groupBy("part").applyInArrow(run, "a long, b long")


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) with those joined that the further ``links`` (a, b) connect; only the components' roots are linked anew."""
    ends = links
    for side in "ab":
        of = roots.select(F.col("node").alias(side), F.col("root").alias("_root"))
        ends = ends.join(of, side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    over = connected_components(ends)
    moved = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("_over")), "root", "left").select("node", F.coalesce("_over", "root").alias("root"))
    return materialize(moved.union(over.join(roots, "node", "left_anti").select("node", "root")), "roots")


def block_links(members: DataFrame, bodies: DataFrame, threshold: float, parts=None, sketches: DataFrame | None = None) -> DataFrame:
    """Links between components within large buckets (band, line, comp, n), two blocks of lines at a time.

    A task holds two blocks of about BLOCK_LINES lines. A line's exact overlaps with all
    others are counted on marks over the shingle ids. Lines that share several buckets meet
    in the one of the least band. Only links leave the task. With ``sketches`` the shingles
    are made only of lines that some sketch says may be alike (see likely).
    """
    held_longs = [] if sketches is None else SKETCH
    least = least_matches(threshold)
    # lines meet texts and sketches once each, not once a bucket
    of_line = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK_LINES).cast("int")).groupBy("line").agg(F.collect_set(F.struct("band", "comp", "blocks")).alias("at"))
    own = F.pmod(F.xxhash64("line", F.lit(1)), F.col("blocks")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))

    def dealt(lines: DataFrame, *more: str) -> DataFrame:
        each = lines.withColumn("bands", F.col("at.band")).withColumn("_at", F.explode("at")).select("line", "bands", "_at.*", *more)
        met = each.withColumn("own", own).withColumn("_at", F.explode(meet))
        return met.select("band", "_at.i", "_at.j", "own", "line", "comp", F.filter("bands", lambda x: x < F.col("band")).alias("before"), *more)

    def unlinked(t: pa.Table) -> np.ndarray:
        """Which pairs (x, y), x < y, of a group's rows are to be looked at."""
        comp, block = t.column("comp").to_numpy(), t.column("own").to_numpy()
        earlier = t.column("before").combine_chunks()
        bands, at = np.unique(earlier.flatten().to_numpy(), return_inverse=True)
        held = np.zeros((len(comp), len(bands)), np.float32)
        held[np.repeat(np.arange(len(comp)), earlier.value_lengths().to_numpy()), at] = 1
        pending = np.triu(comp[:, None] != comp, 1)
        if t.column("i")[0] != t.column("j")[0]:
            pending &= block[:, None] != block
        if not held_longs:
            return pending & (held @ held.T == 0)
        sketch, held = np.column_stack([t.column(c).to_numpy() for c in held_longs]), np.packbits(held > 0, axis=1)
        for lo in range(0, len(pending), 64):
            x, y = np.nonzero(pending[lo : lo + 64])
            pending[x + lo, y] = matches_of(sketch[x + lo], sketch[y]) >= least
            # only for the few pairs left it matters in which bucket they meet
            x, y = np.nonzero(pending[lo : lo + 64])
            for at in range(0, len(x), 4096):
                u, v = x[at : at + 4096] + lo, y[at : at + 4096]
                pending[u, v] = ~(held[u] & held[v]).any(1)
        return pending

    def used(t: pa.Table) -> pa.Table:
        pending = unlinked(t)
        return t.filter(pa.array(pending.any(0) | pending.any(1)))

    if sketches is None:
        given = dealt(of_line.join(bodies, "line"), "body")
    else:
        # only lines that some sketch says may be alike meet their texts
        some = dealt(of_line.join(sketches, "line"), *held_longs)
        some = some.groupBy("band", "i", "j").applyInArrow(used, some.schema)
        kept = [c for c in some.columns if c not in ("line", *held_longs)]
        lists = some.groupBy("line").agg(F.collect_list(F.struct(*kept)).alias("at"), *[F.first(c).alias(c) for c in held_longs])
        given = lists.join(bodies, "line").withColumn("at", F.explode("at")).select("at.*", "line", "body", *held_longs)

    def run(t: pa.Table) -> pa.Table:
        body, line, group, a, b = t.column("body").to_pylist(), t.column("line").to_numpy(), t.column("comp").to_numpy().copy(), [], []
        pending = unlinked(t)
        used = np.flatnonzero(pending.any(0) | pending.any(1))
        if not len(used):
            return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        pending, group, line = pending[np.ix_(used, used)], group[used], line[used]
        packed = packed_shingles([body[i] for i in used.tolist()]) if parts is None else None
        names: dict = {}
        own = packed or [np.array([names.setdefault(g, len(names)) for g in (parts or shingles)(body[i])]) for i in used.tolist()]
        ids, sizes = np.concatenate(own), np.array([len(x) for x in own])
        if packed:
            found, ids = np.unique(ids, return_inverse=True)
        starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(found) if packed else len(names), bool)
        own = np.split(ids, starts[1:])
        for x in np.flatnonzero(pending.any(1)).tolist():
            other = np.flatnonzero(pending[x] & (group != group[x]) & (np.minimum(sizes, sizes[x]) >= threshold * np.maximum(sizes, sizes[x])))
            mark[own[x]] = True
            for y in other.tolist():
                if group[x] != group[y]:
                    both = np.count_nonzero(mark[own[y]])
                    if both >= threshold * (sizes[x] + sizes[y] - both):
                        group[group == group[y]] = group[x]
                        a.append(min(line[x], line[y]))
                        b.append(max(line[x], line[y]))
            mark[own[x]] = False
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return given.groupBy("band", "i", "j").applyInArrow(run, "a long, b long")


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with repeated and near-repeated lines gone from text, and columns n_lines and n_removed added.

    Two lines are near copies if the sets of their 5-character shingles have a Jaccard
    similarity of ``threshold`` or more; candidates share one of twenty bands of five
    MinHash values (a pair at 0.8 is found with a chance of 0.9996, at 0.85 of 0.99999).
    Each bucket links its members with its least and with the one before; pairs that no
    path joins then are tried too, so no candidate pair that is similar stays apart.
    Of each component the first line stays, by (doc_id, hash of the row, line number).

    Blank lines always stay. Lines of fewer than five characters match only as exact
    copies. A null text stays null and an empty one empty (no lines); a text may end up
    empty. Rows alike in doc_id and text count as one document and come out alike; null
    doc_ids come first. An empty table gives no rows. All columns of ``docs`` are kept
    but text, which changes, and n_chars (if there), which follows it; columns named
    n_lines and n_removed are replaced.
    """
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("doc_id", "text").alias("doc_key"), "text").where("text is not null")
    whole = materialize(signed_lines(keyed), "lines")
    roots = line_components(docs.select("text"), whole, threshold)
    # bands and sketches, most of the table, are no longer needed
    signed = materialize(whole.select("doc", "doc_key", "line_no", "line"), "places")
    discard(whole)
    # one row per distinct line: its first place and count, then the first place of its component
    place = F.struct("doc", "doc_key", "line_no")
    each = materialize(signed.groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    near = materialize(each.join(roots, each.line == roots.node).select("line", "first", "n", "root"), "near")
    of_root = materialize(near.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("members")), "firsts")
    joined = join_common(near, of_root, "root", "members").select("line", F.col("least").alias("first"), "n")
    repeated = materialize(joined.union(each.where("n > 1").join(roots.select(F.col("node").alias("line")), "line", "left_anti").select("line", "first", "n")), "repeated")
    discard(each, near, of_root)
    release(docs.sparkSession)
    places = join_common(signed.select("doc_key", "line_no", "line"), repeated, "line")
    gone = places.where("not (first.doc_key = doc_key and first.line_no = line_no)").groupBy("doc_key").agg(F.collect_set("line_no").alias("_gone"))
    kept = docs.drop("n_lines", "n_removed").withColumn("_key", F.xxhash64("doc_id", "text"))
    # texts are not sorted: a partition's lists of lines to drop are held by key
    joined = kept.join(gone.hint("shuffle_hash"), kept["_key"] == gone["doc_key"], "left").drop("_key", "doc_key")
    lines = F.split("text", "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(lines))
    out = joined.withColumn("n_lines", n_lines).withColumn("n_removed", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))).withColumn("text", text).drop("_gone")
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out
