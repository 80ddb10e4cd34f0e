"""SimHash near-duplicate groups: generalised pigeonhole search on distinct fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_common, materialize
from .components import connected_components
from .lines import _ODD, CHUNK, PER_BAND, banded_components, folded
from .tokens import texts

BITS = 64
#: MinHash bands of whole documents (the pipeline's near-copy stage), of PER_BAND values each.
DOCUMENT_BANDS = 14


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle: words between ASCII white space, A-Z lower-cased, joined by a space."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    starts = np.cumsum([0, *[len(p) + 1 for p in parts]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[words:])), np.uint64, len(parts) - words + 1)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash; a bit is 1 if it is set in over half of the shingles' hashes."""
    return from_hashes(shingle_hashes(text, words))


def from_hashes(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in texts(batches):
            fps = np.array([fingerprint(x, words) for x in bodies], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of how often two bits are both set, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    cells = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for r in cells:
        both[r["cell"]] = r["n"]
    return fps.count(), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` groups of equal width so that correlated bits share a group."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        width = len(free) // (parts - g)
        first = max(free, key=lambda i: (corr[i, list(free)].sum(), -i))
        group = [first]
        free.remove(first)
        while len(group) < width:
            best = max(free, key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, radius: int) -> np.ndarray:
    """Chance that two independent draws of bits with set-rates p differ in at most 0..radius bits."""
    exactly = np.zeros(radius + 1)
    exactly[0] = 1
    for d in 2 * p * (1 - p):
        exactly = exactly * (1 - d) + np.concatenate([[0], exactly[:-1]]) * d
    return np.cumsum(exactly)


def allot(costs: list[list[float]], radius: int) -> list[int]:
    """Thresholds t_i >= -1 (-1: part unused) with sum of (t_i + 1) = radius + 1 of least total cost.

    costs[i][t + 1] is what threshold t costs in part i. By the general pigeonhole
    principle, two words within ``radius`` bits are within t_i in some part i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, ts) in best.items():
            for k in range(radius + 2 - used):
                found = (so_far + cost[k], [*ts, k - 1])
                if used + k not in then or found < then[used + k]:
                    then[used + k] = found
        best = then
    return best[radius + 1][1]


def part_value(bits: list[int]):
    """Column expression: the chosen bits of fp, moved together."""
    value = F.lit(0).cast("long")
    for to, at in enumerate(bits):
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(F.lit(1)), to))
    return value


def choose_parts(fps: DataFrame, radius: int, options=(3, 4, 5)) -> tuple[list[list[int]], list[int]]:
    """Bit groups and thresholds with the fewest estimated candidates and probes.

    The number of candidates at threshold 0 is counted over all fingerprints (the sum
    of squared bucket sizes); wider thresholds scale it by the chance, at the measured
    bit rates, that parts differ in so many bits.
    """
    n, both = bit_moments(fps)
    rates = np.diag(both) / max(n, 1)
    trials = [(m, g) for m in options if m <= radius + 3 for g in group_bits(n, both, m)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), part_value(g).alias("value")) for i, (_, g) in enumerate(trials)])).alias("x")
    sizes = fps.select(each).groupBy("x.part", "x.value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = {r["part"]: r["pairs"] for r in sizes.groupBy("part").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()}
    found = []
    for m in options:
        mine = [(i, g) for i, (k, g) in enumerate(trials) if k == m]
        if not mine:
            continue
        costs = []
        for i, g in mine:
            chance, probes = within(rates[g], radius), np.cumsum([1, len(g), *[len(g) * (len(g) - 1) // 2] * (radius - 1)])
            costs.append([0.0, *[float(pairs.get(i, 0) * c / max(chance[0], 1e-12) + n * k) for c, k in zip(chance, probes)]])
        ts = allot(costs, radius)
        found.append((sum(c[t + 1] for c, t in zip(costs, ts)), [g for _, g in mine], ts))
    _, groups, ts = min(found, key=lambda x: x[0])
    return groups, ts


def flips(width: int, radius: int):
    """Masks of at most ``radius`` (0, 1 or 2) set bits out of ``width``."""
    masks = [0]
    if radius >= 1:
        masks += [1 << i for i in range(width)]
    if radius >= 2:
        masks += [(1 << i) | (1 << j) for i in range(width) for j in range(i)]
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_bits(bits: list[int], parts: int) -> list[list[int]]:
    """Dealt into ``parts`` runs of near-equal width."""
    return [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]


def finer_keys(members: DataFrame, hot: DataFrame, paths: dict[int, tuple[list[int], int]], radius: int) -> tuple[DataFrame, dict[int, tuple[list[int], int]]]:
    """Members (fp, part, value) of hot buckets once per sub-part: the bucket's value and the sub-part's bits together.

    ``paths`` has each part's bits not used yet and the width of its value. Two words of
    a bucket within ``radius`` bits agree in one of radius + 1 sub-parts of these bits.
    """
    finer, keys = {}, {}
    for path, (left, width) in paths.items():
        keys[path] = []
        for sub in split_bits(left, radius + 1):
            to = len(finer)
            finer[to] = ([x for x in left if x not in sub], width + len(sub))
            keys[path].append(F.struct(F.lit(to).alias("part"), F.col("value").bitwiseOR(F.shiftleft(part_value(sub), width)).alias("value")))
    each = F.lit(None).cast("array<struct<part:int,value:bigint>>")
    for path, structs in keys.items():
        each = F.when(F.col("part") == path, F.array(*structs)).otherwise(each)
    return members.join(hot, ["part", "value"]).select("fp", F.explode(each).alias("x")).select("fp", "x.part", "x.value"), finer


def fingerprint_links(fps: DataFrame, radius: int = 2, hot_bucket: int = 64, levels: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints: all pairs within ``radius`` (<= 2) bits, or paths for them.

    Parts with a threshold t >= 0 are probed with every value within t bits; candidates
    are verified in the join itself, so only true links leave it. A bucket of more than
    ``hot_bucket`` fingerprints is not paired but cut by the same principle on the bits
    that its part doesn't hold, ``levels`` times at most. The third level's buckets agree in
    some 45 bits; members of those that are still large meet at centres instead, the 65
    words within one bit of a fingerprint: two words are within two bits exactly if they
    share a centre, so linking each word with the least word of the centre is exact and
    linear in the bucket's size.
    """
    if radius > 2:
        raise ValueError("centres cover two bits at most")
    groups, ts = choose_parts(fps, radius)
    probes, index, paths = [], [], {}
    for i, (bits, t) in enumerate(zip(groups, ts)):
        if t >= 0:
            value = part_value(bits)
            index.append(F.struct(F.lit(i).alias("part"), value.alias("value")))
            probes += [F.struct(F.lit(i).alias("part"), value.bitwiseXOR(F.lit(m)).alias("value")) for m in flips(len(bits), t)]
            paths[i] = ([x for x in range(BITS) if x not in bits], len(bits))
    indexed = fps.select("fp", F.explode(F.array(*index)).alias("x")).select("fp", "x.part", "x.value")
    probing = indexed if max(ts) == 0 else fps.select("fp", F.explode(F.array(*probes)).alias("x")).select("fp", "x.part", "x.value")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    found = []
    for level in range(levels):
        alone = probing is indexed
        sizes = indexed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
        hot = materialize(sizes.where(F.col("n") > hot_bucket).select("part", "value"), "hot")
        last = hot.isEmpty()
        pairing = (indexed, probing) if last else tuple(x.join(hot, ["part", "value"], "left_anti") for x in (indexed, probing))
        found.append(pairing[0].join(pairing[1].withColumnRenamed("fp", "other"), ["part", "value"]).where(near & (F.col("fp") != F.col("other"))).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")))
        if last:
            break
        if level == levels - 1:
            found.append(centre_links(indexed.join(hot, ["part", "value"]).union(probing.join(hot, ["part", "value"])).select("fp").distinct(), radius))
        else:
            finer, after = finer_keys(indexed, hot, paths, radius)
            indexed = materialize(finer, "finer")
            probing = indexed if alone else materialize(finer_keys(probing, hot, paths, radius)[0], "finer")
            paths = after
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links.distinct()


def centre_links(meeting: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of each word (fp) with the least word that shares one of its centres."""
    around = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(signed(m))) for m in flips(BITS, radius - 1)])) if radius else F.col("fp")
    centres = materialize(meeting.select("fp", around.alias("centre")), "centres")
    least = centres.groupBy("centre").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("centre", "a")
    return centres.join(least, "centre").where("a <> fp").select("a", F.col("fp").alias("b"))


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Null and empty texts have fingerprint zero and are linked like any other. Equal
    texts share a fingerprint, so copies are joined by value and never paired. Rows that
    repeat a doc_id keep a row each; component_id is the least non-null doc_id of the
    component, null if it has none. An empty table gives no rows; further columns are
    not read.
    """
    fps = materialize(fingerprints(docs, words), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    if distinct.isEmpty():
        return fps.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius))
    rooted = materialize(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", "root"), "rooted")
    by_root = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members"))
    linked = join_common(rooted.where("root is not null"), by_root, "root", "members").select("fp", "n", F.col("component").alias("component_id"))
    named = materialize(linked.union(rooted.where("root is null").select("fp", "n", F.col("least").alias("component_id"))), "named")
    return join_common(fps, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str, words: int = 5) -> set[int]:
    return set(shingle_hashes(text, words).tolist())


def document_bands(hashes: list[np.ndarray]) -> np.ndarray:
    """Band keys (documents x DOCUMENT_BANDS) of MinHash values over each document's shingle hashes (at least one)."""
    h = (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *[len(x) for x in hashes[:-1]]])
    mixed, least = np.empty_like(h), []
    for k in range(DOCUMENT_BANDS * PER_BAND):
        np.bitwise_xor(h, _ODD[0, k], out=mixed)
        np.multiply(mixed, _ODD[1, k], out=mixed)
        least.append(np.minimum.reduceat(mixed, starts))
    return folded(np.array(least), DOCUMENT_BANDS).view(np.int64)


def signed_documents(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, line, fp, bands): line is the XXH64 of the word sequence, bands null where there is no word."""
    schema = "row_key long, doc_id long, line long, fp long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, texts_ = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(keys):
                hashes, lines_, fps, size, start = [], [], [], 0, at
                while at < len(keys) and size < CHUNK:
                    h = shingle_hashes(texts_[at], 5)
                    hashes.append(h)
                    lines_.append(xxhash.xxh64_intdigest(b" ".join((texts_[at] or "").encode().lower().split()), 42))
                    fps.append(from_hashes(h))
                    size += len(h)
                    at += 1
                full = [h for h in hashes if len(h)]
                found = iter(document_bands(full).tolist() if full else [])
                bands = [next(found) if len(h) else None for h in hashes]
                longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                columns = [pa.array(keys[start:at], pa.int64()), pa.array(ids[start:at], pa.int64()), longs(lines_), longs(fps), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["row_key", "doc_id", "line", "fp", "bands"])

    return docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def normal_texts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, body): the word sequences of the given ``line`` hashes, one row each, words one space apart."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    body = F.trim(F.regexp_replace(F.translate(F.col("text").cast("string"), upper, upper.lower()), r"[\x20\x09-\x0D]+", " "))
    each = docs.select(body.alias("body")).withColumn("line", F.xxhash64("body"))
    return materialize(each.join(lines, "line", "left_semi").groupBy("line").agg(F.min("body").alias("body")), "bodies")


def near_copies(docs: DataFrame, signed: DataFrame, threshold: float, radius: int) -> DataFrame:
    """(node, root) over the word sequences that have a near copy.

    Candidates are the pairs whose SimHash fingerprints lie within ``radius`` bits and
    those that share a MinHash band; both are verified by the exact Jaccard similarity
    of the sets of 5-word shingles.
    """
    distinct = materialize(signed.groupBy("line").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")).where("bands is not null"), "distinct")
    if distinct.isEmpty():
        return distinct.select(F.col("line").alias("node"), F.col("line").alias("root"))
    reps = materialize(distinct.groupBy("fp").agg(F.min("line").alias("rep")), "reps")
    one_fp = distinct.join(reps, "fp").where("line <> rep").select(F.col("rep").alias("a"), F.col("line").alias("b"))
    links = fingerprint_links(reps.select("fp"), radius)
    of_a, of_b = reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb"))
    near_fp = links.join(of_a, "a").join(of_b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    pairs = materialize(one_fp.union(near_fp), "simhash")
    banded = distinct.select("line", F.explode("bands").alias("band"))
    return banded_components(banded, lambda few: normal_texts(docs, few), threshold, shingle_set, pairs)


def first_of_groups(docs: DataFrame, threshold: float = 0.8, radius: int = 2) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that of the least doc_id, of equal ids the least row hash.

    Near copies have sets of 5-word shingles with a Jaccard similarity of ``threshold``
    or more, or are joined by a path of such. At 0.8 SimHash fingerprints differ in about
    ten bits, too many for a selective search, so MinHash bands propose pairs beside the
    fingerprints within ``radius`` bits (a pair at 0.8 is found with a chance of 0.996).
    Texts of the same words are one group, those without any word too; texts of fewer
    than five words match only if equal. Rows with a null doc_id stay, of rows alike in
    doc_id and text one stays. An empty table gives no rows. All columns are kept.
    """
    signed = materialize(signed_documents(docs), "signed")
    roots = near_copies(docs, signed, threshold, radius)
    least = signed.where("doc_id is not null").groupBy("line").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    grouped = least.join(roots, least.line == roots.node, "left").groupBy(F.coalesce("root", "line")).agg(F.min("first").alias("first"))
    stay = materialize(grouped.select(F.col("first.row_key").alias("_key")), "stay")
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    kept = keyed.where("doc_id is not null").join(stay, "_key", "left_semi")
    counts = signed.where("doc_id is not null").groupBy("row_key").agg(F.count(F.lit(1)).alias("n"))
    twice = materialize(counts.where("n > 1").select(F.col("row_key").alias("_key")), "twice")
    if not twice.isEmpty():
        nth = F.row_number().over(Window.partitionBy("_key").orderBy("doc_id"))
        single = kept.join(twice, "_key", "left_semi").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
        kept = kept.join(twice, "_key", "left_anti").union(single.select(kept.columns))
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))
