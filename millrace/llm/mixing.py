"""Mixing sources to target weights by entropy balancing, with DataFrame operations only."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import positions
from ..sources.tables import ranged
from .common import materialize, salted_rank

WORDS = r"[^\x20\x09-\x0D]+"
ROUNDS = 8


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating over the sources by code point, null last (one row per source)."""
    nth = positions(sources.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_nth")
    return nth.withColumn("weight", (F.pmod("_nth", F.lit(3)) + 1).cast("double")).drop("_null", "_nth")


def capped_targets(sources: DataFrame, cap: float) -> DataFrame:
    """Share the total of source_size by weight; no target above cap * source_size, the excess reshared by weight.

    With sources ordered by cap / weight, those below the common level stop at their
    cap; the level is what remains over the weights that remain. Sources are summed in
    sorted ranges, each of which takes over the sums of those before it, so their number
    may be large. One row per source.
    """
    limit = F.lit(float(cap)) * F.col("source_size")
    told = sources.withColumn("limit", limit).withColumn("fill", F.col("limit") / F.col("weight")).withColumn("_null", F.col("source").isNull())
    parts = ranged(told, *map(F.col, ("fill", "_null", "source")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    of_part = parts.groupBy("_part").agg(F.sum("limit").alias("l"), F.sum("weight").alias("w"), F.sum("source_size").alias("s"))
    carried = of_part.select(F.col("_part").alias("__part"), F.coalesce(F.sum("l").over(before), zero).alias("_l"), F.coalesce(F.sum("w").over(before), zero).alias("_w"), F.sum("w").over(whole).alias("_weights"), F.sum("s").over(whole).alias("_total"))
    own = Window.partitionBy("_part").orderBy("fill", "_null", "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumns({"_ol": F.coalesce(F.sum("limit").over(own), zero), "_ow": F.coalesce(F.sum("weight").over(own), zero)})
    rows = rows.join(carried, F.col("_part") == F.col("__part"))
    level = (F.col("_total") - F.col("_l") - F.col("_ol")) / (F.col("_weights") - F.col("_w") - F.col("_ow"))
    rows = materialize(rows.select("source", "source_size", "weight", "limit", "fill", "_null", level.alias("level")), "levels")
    # the first source that the level of its own place does not fill sets the level for all after it;
    # of sources alike in fill too it has to be the first, whose level counts all of them
    free = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("fill", "_null", "source", "level"))
    common = rows.agg(F.coalesce(F.min(free)["level"], F.lit(float("inf"))).alias("common"))
    return rows.join(F.broadcast(common)).select("source", "source_size", "weight", F.least("limit", F.col("common") * F.col("weight")).alias("target"))


def tilted_rates(stats: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-9, most: int = 80) -> DataFrame:
    """Lambda of each source, by safeguarded Newton iterations on the convex dual of entropy balancing.

    Among all document rates r the mix takes those with the least relative entropy to
    the base rates b, summed over words, that meet each source's target under the cap:
    r = min(cap, b * exp(lambda)). The dual's gradient in lambda is sum(size * r) -
    target, its second derivative the same sum over rates below the cap. All multipliers
    start at 0, the base rates, and move at once. ``low`` and ``high`` bracket each
    solution; a Newton step of more than 1 (2, 4 and so on in later iterations), or one
    that the cap leaves without a slope, is shortened, one that leaves the bracket
    halves it. Sources not met after ``most`` iterations are warned of. ``stats`` has the words
    per (source, base), which is all that the sums need, so each iteration aggregates
    that table on the cluster. A source without words or target gets no lambda.
    """
    joined = stats.join(targets.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    open_ = joined.groupBy("source").agg(F.sum(F.col("words") * F.col("base")).alias("mass"), F.first("target").alias("target"))
    null = F.lit(None).cast("double")
    lam = materialize(open_.select("source", F.when((F.col("mass") > 0) & (F.col("target") > 0), F.lit(0.0)).alias("lam"), null.alias("low"), null.alias("high")), "lambda")
    for i in range(most):
        rate = F.least(F.lit(float(cap)), F.col("base") * F.exp("lam"))
        at = joined.where("base > 0").join(lam.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").where("lam is not null")
        sums = at.groupBy("source").agg(
            *[F.first(c).alias(c) for c in ("target", "lam", "low", "high")],
            F.sum(F.col("words") * rate).alias("met"),
            F.sum(F.when(rate < cap, F.col("words") * rate).otherwise(0.0)).alias("slope"),
            F.sum(F.col("words") * cap).alias("most"),
        )
        gap = F.col("target") - F.col("met")
        # what all rates at the cap can't meet is met as far as they can
        moves = (F.abs(gap) > tolerance * F.col("target")) & ~((gap > 0) & (F.col("met") >= F.col("most")))
        low, high = F.when(gap > 0, F.col("lam")).otherwise(F.col("low")), F.when(gap < 0, F.col("lam")).otherwise(F.col("high"))
        reach = 2.0 ** min(i, 9)
        newton = F.col("lam") + F.when(F.col("slope") > 0, F.greatest(F.lit(-reach), F.least(F.lit(reach), gap / F.col("slope")))).otherwise(F.signum(gap) * reach)
        told = sums.select("source", "lam", low.alias("low"), high.alias("high"), moves.alias("moves"), newton.alias("newton"))
        kept = (F.col("newton") > F.coalesce("low", F.lit(float("-inf")))) & (F.col("newton") < F.coalesce("high", F.lit(float("inf"))))
        step = told.select("source", F.when(~F.col("moves"), F.col("lam")).when(kept, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2).alias("lam"), "low", "high", "moves")
        lam = materialize(step, "lambda")
        if lam.where("moves").isEmpty():
            break
        if i == most - 1:
            warnings.warn(f"{lam.where('moves').count()} sources have not met their targets after {most} iterations", stacklevel=2)
        lam = lam.drop("moves")
    return lam.select("source", "lam")


def rounded_classes(classes: DataFrame) -> DataFrame:
    """Add ``more``: how many documents of each class (source, rate, size; n of them) get one copy above floor(rate).

    Fractions are carried along the sizes of a source, largest first, so whole classes
    round to counts near n * fraction; then, ROUNDS times, the words still missing
    (or too many) are made up from the largest class that is not larger than them.
    A source has no more classes than there are distinct sizes and base rates.
    """
    source = Window.partitionBy("source")
    along = source.orderBy(F.desc("size"), "rate").rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("n") * (F.col("rate") - F.floor("rate"))
    sums = classes.withColumn("whole", F.floor("rate")).withColumn("ideal", F.floor(F.sum(share).over(along) + 0.5))
    lagged = F.coalesce(F.lag("ideal").over(source.orderBy(F.desc("size"), "rate")), F.lit(0))
    found = sums.withColumn("more", F.least("n", F.col("ideal") - lagged))
    for _ in range(ROUNDS):
        taken = F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("more"))).over(source)
        found = found.withColumn("gap", F.col("target") - taken)
        spare = F.when(F.col("gap") > 0, F.when(F.col("rate") > F.col("whole"), F.col("n") - F.col("more")).otherwise(0)).otherwise(F.col("more"))
        fits = (spare > 0) & (F.col("size") > 0) & (F.col("size") <= F.abs("gap"))
        here = F.when(fits, F.struct("size", "rate"))
        found = found.withColumn("spare", spare).withColumn("here", here).withColumn("best", F.max("here").over(source))
        moved = F.least(F.col("spare"), F.floor(F.abs("gap") / F.col("size"))) * F.signum("gap")
        found = found.withColumn("more", F.when(F.col("here") == F.col("best"), F.col("more") + moved.cast("long")).otherwise(F.col("more")))
    return found.select("source", "rate", "size", "n", "whole", "more")


def entropy_mix(docs: DataFrame, cap: int = 3, base: Column | None = None, weights=cyclic_weights) -> DataFrame:
    """Copies of every document so that each source's words come near its target.

    Returns one row per row of ``docs``: doc_id, source, size (words), source_size,
    target, rate, copies, taken (copies * size). ``base`` is an optional column of base
    rates (null or NaN: 1; below 0: 0), ``weights`` adds a column weight to a table of
    sources. A null text has size 0; null sources are one source of their own; rows
    with equal doc_id or wholly alike count each by itself; documents of size 0 take
    part with no words. An empty table gives no rows. Only doc_id, text, source and
    what ``base`` names are read. Which documents of a class get the extra copy
    follows a hash of doc_id, so reruns agree; rows alike are interchangeable.
    """
    rate0 = F.lit(1.0) if base is None else F.greatest(F.coalesce(F.when(~F.isnan(base.cast("double")), base.cast("double")), F.lit(1.0)), F.lit(0.0))
    sizes = materialize(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), rate0.alias("base")), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(capped_targets(weights(totals), cap), "targets")
    stats = materialize(sizes.groupBy("source", "base").agg(F.sum("size").alias("words")), "stats")
    lam = tilted_rates(stats, targets, cap)
    told = materialize(targets.join(lam.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "told")
    rate = F.coalesce(F.least(F.lit(float(cap)), F.col("base") * F.exp("lam")), F.lit(0.0))
    rated = stats.join(told.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "base", "source_size", "target", rate.alias("rate"))
    rated = materialize(rated, "rates")
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("base") == F.col("_b"))
    each = sizes.join(rated.withColumnsRenamed({"source": "_s", "base": "_b"}), on).drop("_s", "_b")
    classes = each.groupBy("source", "rate", "size").agg(F.count(F.lit(1)).alias("n"), F.first("target").alias("target"))
    extra = materialize(rounded_classes(classes), "classes")
    ranked = salted_rank(each, ["source", "rate", "size"], ["doc_id"], "nth")
    renamed = extra.select(F.col("source").alias("_s"), F.col("rate").alias("_r"), F.col("size").alias("_z"), "whole", "more")
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("rate") == F.col("_r")) & (F.col("size") == F.col("_z"))
    copies = F.col("whole") + (F.col("nth") < F.col("more")).cast("long")
    return ranked.join(renamed, on).select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as entropy_mix takes it; rows taken no time go."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    keys = ["doc_id", "source", "_size"]
    own = docs.withColumn("_size", size)
    own = own.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("text"))))
    mix = entropy_mix(docs, **options).where("copies > 0").withColumnRenamed("size", "_size")
    mix = mix.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("copies")))
    mix = mix.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_size").alias("_z"), F.col("_nth").alias("_n"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_nth") == F.col("_n"))
    return own.join(mix, same).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)
