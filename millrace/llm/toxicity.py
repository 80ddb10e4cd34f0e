"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import texts

WORD = re.compile(r"\w+")
BLOCK = 512
STEMS = (4, 5, 6)
#: Weight, beside its inverse document frequency, of a term that does not tell the labels apart; telling terms weigh 1.
PLAIN_WEIGHT = 0.05
#: A telling term shifts the odds of a label at least so much, with at least this log-likelihood ratio.
ODDS, LEAST_GAIN = 2, 12.0
#: Share of the vectors from which a term's posting list is one weight per vector.
DENSE = 1 / 16
#: Distinct words whose term ids a worker remembers; it starts afresh beyond that.
CACHE_WORDS = 300_000


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def stems(word: str) -> list[str]:
    """A word's first 4, 5 and 6 letters, where it has more, so that inflected forms can meet."""
    return [f"{word[:n]}*" for n in STEMS if len(word) > n]


class Terms:
    """The vocabulary: every word of the examples, and the stems that tell the labels apart, with their weights.

    A word that no example has is not in the vocabulary; it meets no posting list, but
    counts in its text's norm with the weight ``unheard``.
    """

    def __init__(self, ids: dict[str, int], weight: np.ndarray, unheard: float = 0.0):
        self.ids, self.weight, self.unheard, self.seen = ids, weight, unheard, {}
        #: A word whose first letters are not among these has no stem in the vocabulary.
        self.heads = {x[: STEMS[0]] for x in ids if x[-1] == "*"}

    def of(self, word: str) -> tuple[list[int], bool]:
        """Term ids of a word, its own and its stems', and whether the word itself is in the vocabulary."""
        at = self.seen.get(word)
        if at is None:
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            terms = (word, *stems(word)) if word[: STEMS[0]] in self.heads else (word,)
            self.seen[word] = at = [self.ids[x] for x in terms if x in self.ids], word in self.ids
        return at

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term ids in rising order and weights, (1 + log tf) * idf * telling weight, of a whole text at unit length; words outside the vocabulary are part of that length."""
        found, times, others = [], [], 0.0
        for word, n in Counter(words(text)).items():
            at, heard = self.of(word)
            for i in at:
                found.append(i)
                times.append(n)
            if not heard:
                others += (1 + math.log(n)) ** 2
        at, place = np.unique(np.array(found, np.int64), return_inverse=True)
        w = (1 + np.log(np.bincount(place, times, len(at)))) * self.weight[at]
        norm = math.sqrt(float(w @ w) + others * self.unheard**2)
        return (at, w / norm) if len(at) and norm else (at[:0], w[:0])


def runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges starts[i]..ends[i] - 1, one range after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class BlockMaxIndex:
    """Posting lists of unit vectors, cut at blocks of BLOCK alike vectors, with each list's largest weight in each block.

    The list of a term that DENSE of the vectors or more hold is kept as one weight per
    vector (0 where there is none), which is shorter than a list of places.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list[int], n_terms: int):
        heavy = [tuple(v[0][np.argsort(-v[1], kind="stable")][:8].tolist()) for v in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (heavy[i], ids[i]))
        self.rows = np.array(order, np.int64)
        self.ids = np.array([ids[i] for i in order], np.int64)
        doc = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        term = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)])
        weight = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        self.n_blocks = -(-len(order) // BLOCK)
        held = np.bincount(term, minlength=n_terms)
        often = np.flatnonzero(held >= max(DENSE * len(order), 1))
        self.slot = np.full(n_terms, -1)
        self.slot[often] = np.arange(len(often))
        self.rows_of = np.zeros((len(often), len(order)))
        dense = self.slot[term] >= 0
        self.rows_of[self.slot[term[dense]], doc[dense]] = weight[dense]
        self.row_maxima = np.maximum.reduceat(self.rows_of, np.arange(0, max(len(order), 1), BLOCK), axis=1) if len(order) else np.zeros((0, 0))
        doc, term, weight = doc[~dense], term[~dense], weight[~dense]
        # postings by (term, vector): those of a term in a block lie together
        by = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[by].astype(np.int32), weight[by], term[by]
        piece = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(self.doc // BLOCK) != 0)])) if len(by) else np.zeros(0, np.int64)
        self.piece_from, self.piece_to = piece, np.append(piece[1:], len(by))
        self.piece_block = self.doc[piece] // BLOCK if len(by) else piece
        self.maxima = np.maximum.reduceat(self.weight, piece) if len(by) else np.zeros(0)
        self.term_from = np.searchsorted(term[piece] if len(by) else piece, np.arange(n_terms + 1))

    def frequent(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """What the frequent terms add to each query's cosine with every vector, and to its bound for every block."""
        w = np.zeros((len(vectors), len(self.rows_of)))
        for i, (at, own) in enumerate(vectors):
            slot = self.slot[at]
            w[i, slot[slot >= 0]] = own[slot >= 0]
        return w @ self.rows_of, w @ self.row_maxima

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, frequent: tuple[np.ndarray, np.ndarray], without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places in the index and cosines of the k nearest vectors of positive cosine; ties to the lesser id.

        ``frequent`` are the query's rows of that method. Blocks are visited by falling sum
        of the query's list maxima until it is below the k-th cosine.
        """
        added, bounds = frequent
        count = self.term_from[at + 1] - self.term_from[at]
        piece = runs(self.term_from[at], self.term_from[at + 1])
        weight = np.repeat(w, count)
        block = self.piece_block[piece]
        bounds = bounds + np.bincount(block, weight * self.maxima[piece], self.n_blocks)
        by = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[by], np.arange(self.n_blocks + 1))
        piece, weight = piece[by], weight[by]
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or len(best) == k and bounds[b] < best[-1] - 1e-12:
                break
            own = slice(edges[b], edges[b + 1])
            start, end = self.piece_from[piece[own]], self.piece_to[piece[own]]
            post = runs(start, end)
            lo, hi = b * BLOCK, min((b + 1) * BLOCK, len(self.ids))
            cos = np.bincount(self.doc[post] - lo, self.weight[post] * np.repeat(weight[own], end - start), hi - lo)
            cos = np.round(cos + added[lo:hi], 12)
            least = best[-1] if len(best) == k else np.partition(cos, -k - 1)[-k - 1] if len(cos) > k else 0.0
            keep = (cos > 0) & (cos >= least)
            if without is not None and lo <= without < hi:
                keep[without - lo] = False
            if keep.any():
                best_at, best = np.concatenate([best_at, lo + np.flatnonzero(keep)]), np.concatenate([best, cos[keep]])
                top = np.lexsort((self.ids[best_at], -best))[:k]
                best_at, best = best_at[top], best[top]
        return best_at, best


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Steps (least x, value) of the rising weighted fit of y on x, each pool smoothed by one prior row."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable").tolist():
        if pools and pools[-1][0] == x[i]:
            pools[-1][1] += weight[i] * y[i]
            pools[-1][2] += weight[i]
        else:
            pools.append([float(x[i]), float(weight[i] * y[i]), float(weight[i])])
    merged: list[list[float]] = []
    for p in pools:
        merged.append(p)
        while len(merged) > 1 and merged[-2][1] * merged[-1][2] >= merged[-1][1] * merged[-2][2]:
            last = merged.pop()
            merged[-1][1] += last[1]
            merged[-1][2] += last[2]
    return np.array([p[0] for p in merged]), np.array([(p[1] + prior) / (p[2] + 1) for p in merged])


@dataclass
class NearestExamples:
    """The fitted model. Its size is bounded by the words of max_examples texts."""

    terms: Terms
    index: BlockMaxIndex
    toxic: np.ndarray
    k: int
    blank: float
    prior: float
    steps: np.ndarray
    values: np.ndarray

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int | None]) -> list[tuple[float, np.ndarray]]:
        """Share of toxic neighbours, each weighing 1 / (distance + 0.05), with one neighbour's worth of the prior, and the neighbours."""
        out = []
        added, bounds = self.index.frequent(vectors)
        for i, (at, w) in enumerate(vectors):
            near, cos = self.index.nearest(at, w, self.k, (added[i], bounds[i]), without[i])
            pull = 1 / (1.05 - cos)
            out.append((float((pull @ self.toxic[near] + self.prior) / (pull.sum() + 1)), near))
        return out

    def score(self, bodies: list[str | None]) -> list[tuple[float, list[int]]]:
        """Calibrated score of each text and the ids of the neighbours that speak for it."""
        each = list(dict.fromkeys(bodies))
        found: dict = {}
        for lo in range(0, len(each), 128):
            part = each[lo : lo + 128]
            vectors = [self.terms.vector(x) for x in part]
            for text, (at, _), (vote, near) in zip(part, vectors, self.votes(vectors, [None] * len(part))):
                value = float(self.values[max(0, np.searchsorted(self.steps, vote, "right") - 1)])
                found[text] = (value, self.index.ids[near].tolist()) if len(at) else (self.blank, [])
        return [found[x] for x in bodies]


def telling_terms(examples: DataFrame) -> DataFrame:
    """(term) of the words and stems whose presence shifts the odds of the toxic label.

    Terms count by odds, which can shift ODDS times at any share of toxic labels, and by
    their log-likelihood ratio. Counts are summed over all ``examples`` (text, toxic).
    """

    def run(batches):
        n: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n.update((x, toxic) for x in {"", *(f for w in set(words(text)) for f in (w, *stems(w)))})
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n]), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["term", "toxic", "n"])

    counted = examples.select("text", "toxic").mapInArrow(run, "term string, toxic int, n long")
    each = materialize(counted.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).cast("double").alias("t"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).cast("double").alias("c")), "terms")
    total = each.where("term = ''").first()
    T, C = (total["t"], total["c"]) if total else (0.0, 0.0)
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    t, c = F.col("t"), F.col("c")
    seen, both = t + c, T + C or 1.0
    gain = 2 * (part(t, seen * T / both) + part(c, seen * C / both) + part(F.lit(T) - t, (F.lit(T + C) - seen) * T / both) + part(F.lit(C) - c, (F.lit(T + C) - seen) * C / both))
    # odds with the term against odds without it, multiplied out
    held, lacked = t * (F.lit(C) - c), c * (F.lit(T) - t)
    shifts = (held >= ODDS * lacked) | (ODDS * held <= lacked)
    return each.where("term <> ''").where(seen < T + C).where(shifts).where(gain >= LEAST_GAIN).select("term")


def vocabulary(indexed: DataFrame, telling: DataFrame) -> list[tuple[str, bool]]:
    """Every word of the ``indexed`` examples, and their telling stems, each with whether it is telling, in order."""

    def run(batches):
        for batch in batches:
            found = {x for text in batch.column(0).to_pylist() for w in set(words(text)) for x in (w, *stems(w))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["term"])

    terms = indexed.select("text").mapInArrow(run, "term string").distinct()
    told = terms.join(telling.withColumn("telling", F.lit(True)), "term", "left").select("term", F.coalesce("telling", F.lit(False)).alias("telling"))
    return sorted((r["term"], r["telling"]) for r in told.where("telling or right(term, 1) <> '*'").collect())


def document_frequencies(docs: DataFrame, ids: dict[str, int]) -> tuple[int, np.ndarray]:
    """Number of documents and, per term, of those that hold it: over all documents."""
    terms = Terms(ids, np.zeros(0))

    def run(batches):
        n, df = 0, np.zeros(len(terms.ids) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[list({i for w in set(words(text)) for i in terms.of(w)[0]})] += 1
                n += 1
        df[-1] = n
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "n"])

    df = np.zeros(len(ids) + 1)
    for r in docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return int(df[-1]), df[:-1]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_labelled: int = 8192, max_examples: int = 2048, k: int = 15) -> NearestExamples:
    """Fit on a bounded sample of the labelled documents where ``learn`` holds.

    ``max_labelled`` rows, chosen by a hash of doc_id, say which terms tell the labels
    apart; the index holds at most max_examples of them, as far as possible half of
    either label (calibration weighs them back). All words of the indexed examples
    take part in the cosine; telling ones and telling stems weigh 1, the others
    PLAIN_WEIGHT, beside their inverse document frequencies, which come from all of
    ``docs``. Words of no indexed example count in a text's norm as plain words found in
    fewer than one of so many documents. A document with several labels counts as toxic if one says so; labels other
    than 0 and 1, null ids and labels without a document have no effect; of rows that
    share an id each is an example. What reaches the driver and the tasks is bounded by
    the words of max_examples texts.
    """
    known = labels.where(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # bounded by max_labelled rows
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    order = [F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")]
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").orderBy(*order).limit(max_labelled)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labelled = materialize(labelled.repartition(parts, "doc_id"), "labelled")
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    of_toxic = min(n_toxic, max(max_examples // 2, max_examples - n_clean))
    of_clean = min(n_clean, max_examples - of_toxic)
    part = lambda toxic, n: labelled.where(F.col("toxic") == toxic).orderBy(*order).limit(n)
    indexed = materialize(part(1, of_toxic).union(part(0, of_clean)), "examples")
    told = vocabulary(indexed, telling_terms(labelled)) if n_toxic and n_clean else []
    ids = {w: i for i, (w, _) in enumerate(told)}
    n, df = document_frequencies(docs, ids) if ids else (0, np.zeros(0))
    # a word of none of the examples is taken to be in fewer than one document of so many
    unheard = PLAIN_WEIGHT * (math.log(of_toxic + of_clean + 1) + 1)
    terms = Terms(ids, (np.log((1 + n) / (1 + df)) + 1) * np.where([x for _, x in told], 1.0, PLAIN_WEIGHT) if ids else np.zeros(0), unheard)

    def vectors(batches):
        for batch in batches:
            found = [terms.vector(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v[0].tolist() for v in found], pa.list_(pa.int64())), pa.array([v[1].tolist() for v in found], pa.list_(pa.float64()))], ["doc_id", "toxic", "at", "w"])

    rows = sorted(indexed.select("doc_id", "text", "toxic").mapInArrow(vectors, "doc_id long, toxic int, at array<long>, w array<double>").collect(), key=lambda r: (r["doc_id"], r["at"], r["w"]))
    # an example stands for so many labelled rows of its label
    worth = {1: n_toxic / max(of_toxic, 1), 0: n_clean / max(of_clean, 1)}
    full, void = [r for r in rows if r["at"]], [r["toxic"] for r in rows if not r["at"]]
    prior = (n_toxic + 0.1) / (n_toxic + n_clean + 1)
    blank = (worth[1] * sum(void) + prior) / (worth[1] * sum(void) + worth[0] * (len(void) - sum(void)) + 1)
    index = BlockMaxIndex([(np.array(r["at"], np.int64), np.array(r["w"])) for r in full], [r["doc_id"] for r in full], len(ids))
    model = NearestExamples(terms, index, np.array([full[i]["toxic"] for i in index.rows], float), k, blank, prior, np.zeros(1), np.array([prior]))
    if full:
        order = [(np.array(full[i]["at"]), np.array(full[i]["w"])) for i in index.rows]
        votes = np.array([v for v, _ in model.votes(order, list(range(len(order))))])
        model.steps, model.values = isotonic(np.round(votes, 9), model.toxic, np.where(model.toxic == 1, worth[1], worth[0]), prior)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> DataFrame:
    """(doc_id, score, predicted, neighbours) for every row of ``docs``.

    score is the calibrated chance of the toxic label, predicted 1 from 0.5 on,
    neighbours the example ids behind it. Null and empty texts, and texts without any
    word of the examples, score the rate of such examples. A null doc_id stays null;
    repeated rows score each by itself; equal cosines go to the lesser id. Without
    examples every score is 0.1, with examples of one label only it is the rate of that
    label, drawn a little towards it from 0.1 of a toxic row. An empty table gives no
    rows; only doc_id and text of ``docs`` are read, labels never enter.
    """
    model = fit(docs, labels, learn, **options)

    def run(batches):
        for ids, bodies in texts(batches):
            found = model.score(bodies)
            scores = np.array([s for s, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array([n for _, n in found], pa.list_(pa.int64()))], ["doc_id", "score", "predicted", "neighbours"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, neighbours array<long>")


def without_toxic(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns; see score_toxicity.

    Rows are filtered where they lie, so nothing is joined or moved.
    """
    model = fit(docs, labels, learn, **options)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield part.filter(pa.array([score < 0.5 for score, _ in model.score(part.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
