"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DIMS, GRAMS = 1 << 13, (1, 2, 3)
#: Languages in one model, and how sharply the score tells cosines apart.
LANGS, SHARP = 256, 30
#: Code points counted at once.
CHUNK = 1 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of the lower-cased text's character 1- to 3-grams, hashed to DIMS places; the whole text counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # runs of white space, digits and ASCII marks are one space: they tell nothing of the language
    codes = np.where((codes < 128) & ((codes < 97) | (codes > 122)), np.uint32(32), codes)
    codes = codes[(codes != 32) | (np.concatenate([[0], codes[:-1]]) != 32)]
    total = np.zeros(DIMS, np.int64)
    for at in range(0, len(codes), CHUNK):
        part = codes[at : at + CHUNK + max(GRAMS) - 1]
        for n in GRAMS:
            places = min(CHUNK, len(part) - n + 1)
            if places > 0:
                h = np.full(places, n, np.uint32)
                for i in range(n):
                    h = (h ^ part[i : i + places]) * _MIX[i]
                total += np.bincount(h >> np.uint32(32 - 13), minlength=DIMS)
    return total


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of square-root term frequency times idf, at unit length (zero rows stay zero)."""
    v = np.sqrt(counts) * idf
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids of unit rows by spherical k-means from farthest-point seeds."""
    seeds = [v.sum(0)]
    while len(seeds) < min(k, len(v)):
        seeds.append(v[np.argmin(np.max(v @ np.array(seeds).T / np.linalg.norm(seeds, axis=1), axis=1))])
    c = np.array(seeds) / np.linalg.norm(seeds, axis=1, keepdims=True)
    for _ in range(rounds):
        nearest = np.argmax(v @ c.T, axis=1)
        sums = np.array([v[nearest == i].sum(0) for i in range(len(c)) if (nearest == i).any()])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Centroids:
    idf: np.ndarray
    langs: list[str]
    of: np.ndarray
    vectors: np.ndarray
    radius: np.ndarray

    def nearest(self, bodies: list[str | None]) -> list[tuple[str, float, float, bool] | None]:
        """Per text with a letter: the nearest centroid's language, its cosine, the sum of exp(SHARP * cosine) over languages, and whether it is beyond its language's radius."""
        found: list = [None] * len(bodies)
        at = [i for i, x in enumerate(bodies) if x and any(map(str.isalpha, x))]
        for lo in range(0, len(at), 128):
            rows = at[lo : lo + 128]
            cos = unit(np.array([gram_counts(bodies[i]) for i in rows]), self.idf) @ self.vectors.T
            best = np.stack([cos[:, self.of == j].max(1) for j in range(len(self.langs))], axis=1)
            top = np.argmax(best, axis=1)
            for i, j, b in zip(rows, top.tolist(), best):
                found[i] = (self.langs[j], float(b[j]), float(np.exp(SHARP * b.astype(float)).sum()), bool(1 - b[j] > self.radius[j]))
        return found


def sampled(train: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` different rows of each lang, those of the least hashes of (doc_id, text); rows alike are one.

    Of a language with many different rows only those whose hash is below a share of the
    range that holds some three times the sample go on to be ranked, so no task gathers
    a language. The share counts different rows, so a language never depends on one hash.
    """
    hashed = train.withColumn("_h", F.xxhash64("doc_id", "text"))
    own = hashed.select("lang", "_h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(own.select(F.col("lang").alias("_lang"), "n"), "languages")
    share = (3 * sample + 64) / F.col("n")
    few = hashed.join(counts, hashed["lang"] == counts["_lang"]).where(F.col("_h").cast("double") / 2.0**64 + 0.5 <= share)
    by = Window.partitionBy("lang").orderBy("_h")
    return few.select("lang", "_h", "text").dropDuplicates(["lang", "_h"]).withColumn("_nth", F.row_number().over(by)).where(F.col("_nth") <= sample).select("lang", "text")


def fit(docs: DataFrame, learn: Column, sample: int = 400, clusters: int = 4) -> list[Centroids]:
    """Centroids from rows where ``learn`` holds and text and lang are not null: one model for every LANGS languages.

    Document frequencies come from all these rows. Centroids are clustered from at most
    ``sample`` different rows of each language (rows, not ids: of an id's rows each
    may be taken), which bounds every task's share. A model takes some 130 KB a language, so languages are
    dealt into models of at most LANGS, whatever their number.
    """
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull())

    def frequencies(batches):
        n, df = 0, np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[:-1] += gram_counts(text) > 0
                n += 1
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(df)], ["place", "n"])

    df = np.zeros(DIMS + 1)
    for r in train.select("text").mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        df[r["place"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    rows = materialize(sampled(train, sample), "language-sample")

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        v = unit(np.array([gram_counts(x) for x in pdf["text"]]), idf)
        v = v[np.linalg.norm(v, axis=1) > 0]
        if not len(v):
            return pd.DataFrame({"lang": [], "radius": [], "vector": []})
        c = clustered(v, clusters)
        radius = min(1.0, 1.5 * float(np.quantile(1 - (v @ c.T).max(1), 0.99)))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "radius": radius, "vector": [x.astype("<f4").tobytes() for x in c]})

    found = materialize(rows.groupBy("lang").applyInPandas(centroids, "lang string, radius double, vector binary"), "centroids")
    names = sorted(r["lang"] for r in found.select("lang").distinct().collect())
    models = []
    for lo in range(0, len(names), LANGS):
        own = names[lo : lo + LANGS]
        place = {x: i for i, x in enumerate(own)}
        part = sorted(found.where(F.col("lang").between(own[0], own[-1])).collect(), key=lambda r: (r["lang"], bytes(r["vector"])))
        vectors = np.array([np.frombuffer(bytes(r["vector"]), "<f4") for r in part], np.float32)
        radius = {r["lang"]: r["radius"] for r in part}
        models.append(Centroids(idf, own, np.array([place[r["lang"]] for r in part]), vectors, np.array([radius[x] for x in own])))
    return models


def identify_language(docs: DataFrame, learn: Column, **options) -> DataFrame:
    """(doc_id, lang_pred, score, distance, rejected) for every row of ``docs``.

    lang_pred is the language of the nearest centroid; ``und`` with score 0 only for
    null texts and texts without a letter (or if nothing could be learned). ``rejected``
    says that the nearest centroid is farther than the radius of its language (1.5
    times the 99th percentile of the sample's own distances), for callers that would
    rather have no answer. Equal distances go to the first language by name.
    However many languages there are, each takes part (LANGS a pass over the texts). Repeated
    rows count each by itself, a null doc_id stays null, an empty table gives no rows;
    no column but text enters a prediction.
    """
    schema = "doc_id long, text string, lang_pred string, cosine double, weight double, rejected boolean"
    best = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    best = best.select("doc_id", "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("cosine"), F.lit(0.0).alias("weight"), F.lit(True).alias("rejected"))
    for model in fit(docs, learn, **options):
        best = best.mapInArrow(better_of(model), schema)
    score = F.exp(SHARP * F.col("cosine")) / F.col("weight")
    return best.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score"), (1 - F.col("cosine")).alias("distance"), "rejected")


def better_of(model: Centroids):
    """A function over batches that takes the model's answer where it is nearer than the one so far."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lang, cosine, weight, far = (part.column(i).to_pylist() for i in range(2, 6))
                for i, hit in enumerate(model.nearest(part.column(1).to_pylist())):
                    if hit:
                        weight[i] += hit[2]
                        if cosine[i] is None or hit[1] > cosine[i]:
                            lang[i], cosine[i], far[i] = hit[0], hit[1], hit[3]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(cosine, pa.float64()), pa.array(weight, pa.float64()), pa.array(far, pa.bool_())], batch.schema.names)

    return run
