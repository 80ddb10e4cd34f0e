"""Tile trees over points of the plane: nearest neighbours and radius sums without meeting every point.

Points are put in Z-order and cut into runs of equal length, the tiles; runs of tiles
make the tiles of the level above, up to a single one. So a tile never holds more than
its share however the points lie, and each level is an ordinary table of (tile, n and
the box around its points). A search starts at the top with every site and goes down
level by level: an equi-join of (site, tile) with the tiles' children, after which each
site keeps just the tiles that can still matter to it.

Boxes are the least and greatest coordinates that occur, and a distance to a box uses
the same operations as one to a point. As these round monotonically, a box never seems
farther than a point in it, so pruning needs no tolerance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .ranges import positions

#: Children of levels with at most this many tiles are joined by broadcast (a tile is some 50 bytes); larger ones by shuffle.
BROADCAST_TILES = 1 << 16
#: Sites of one partition on the way down to their nearest points, about: each meets some hundred tiles and points at once.
PART_SITES = 1 << 10
#: Bits per axis of the Z-order.
Z_BITS = 24


@dataclass
class TileTree:
    """Points with the tile of the lowest level they are in, and the levels' tiles from the lowest up.

    ``points`` has the given columns, y and x as doubles and tile (long). Each level has tile,
    parent (the tile's number divided by ``fan``), n, y0, y1, x0, x1; the last has one tile, 0.
    """

    points: DataFrame
    levels: list[DataFrame]
    sizes: list[int]
    fan: int = 16


def _interleaved(c: Column) -> Column:
    """The Z_BITS bits of a long with a zero bit between any two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def tile_tree(points: DataFrame, id_: str, y: str, x: str, leaf: int = 64, fan: int = 16) -> TileTree:
    """The tile tree of a table of points; points without finite coordinates are left out."""
    finite = F.abs(F.col(y).cast("double")) < float("inf")
    sound = points.withColumns({y: F.col(y).cast("double"), x: F.col(x).cast("double")}).where(finite & (F.abs(F.col(x).cast("double")) < float("inf")))
    box = sound.agg(*[f(c).alias(f"{f.__name__}_{n}") for f in (F.min, F.max) for n, c in (("y", y), ("x", x))], F.count(F.lit(1)).alias("n")).first()
    if not box["n"]:
        none = sound.sparkSession.createDataFrame([], "tile long, parent long, n long, y0 double, y1 double, x0 double, x1 double")
        return TileTree(sound.withColumn("tile", F.lit(0).cast("long")), [none], [0])

    def steps(c: str, name: str) -> Column:
        low, high = box[f"min_{name}"], box[f"max_{name}"]
        # halves, as the width itself may pass the largest double
        share = F.try_divide(F.col(c) / 2 - low / 2, F.lit(high / 2 - low / 2))
        return F.coalesce(F.floor(share * ((1 << Z_BITS) - 1)), F.lit(0)).cast("long")

    around = [F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1")]
    as_box = [F.lit(1).cast("long").alias("n"), F.col(y).alias("y0"), F.col(y).alias("y1"), F.col(x).alias("x0"), F.col(x).alias("x1")]
    if box["n"] <= leaf:
        # always 0, but not a constant to the optimizer, which would turn joins on it into nested loops
        own = sound.withColumn("tile", F.pmod(F.xxhash64(id_), F.lit(1)))
        return TileTree(own, [own.select("tile", F.col("tile").alias("parent"), *as_box).groupBy("tile", "parent").agg(F.sum("n").alias("n"), *around)], [1])
    z = _interleaved(steps(y, "y")).bitwiseOR(F.shiftleft(_interleaved(steps(x, "x")), 1))
    dealt = positions(sound.withColumn("_z", z), [], ["_z", y, x, id_], "_nth")
    own = stored(dealt.withColumn("tile", F.expr(f"_nth div {leaf}")).drop("_z", "_nth"), "points")
    below = own.select("tile", *as_box)
    levels, sizes, n = [], [], -(-box["n"] // leaf)
    while True:
        level = below.groupBy("tile").agg(F.sum("n").alias("n"), *around).withColumn("parent", F.expr(f"tile div {fan}"))
        levels.append(stored(level.select("tile", "parent", "n", "y0", "y1", "x0", "x1"), "tiles"))
        sizes.append(n)
        if n == 1:
            return TileTree(own, levels, sizes, fan)
        below, n = levels[-1].select(F.col("parent").alias("tile"), "n", "y0", "y1", "x0", "x1"), -(-n // fan)


def distance(dy: Column, dx: Column) -> Column:
    return F.sqrt(dy * dy + dx * dx)


def _gaps(at: str, low: str, high: str) -> tuple[Column, Column]:
    """How far a coordinate lies from a box's nearest and farthest points on that axis."""
    under, over = F.col(low) - F.col(at), F.col(at) - F.col(high)
    return F.greatest(under, over, F.lit(0.0)), F.greatest(F.abs(under), F.abs(over))


def _met(pairs: DataFrame) -> DataFrame:
    """(site, tile) pairs with a tile's box, to the least and greatest distance of its points."""
    (ny, fy), (nx, fx) = _gaps("_sy", "y0", "y1"), _gaps("_sx", "x0", "x1")
    return pairs.select("_site", "_sy", "_sx", "tile", "n", distance(ny, nx).alias("near"), distance(fy, fx).alias("far"))


def _at_the_top(sites: DataFrame, tree: TileTree, site: str, y: str, x: str) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """Every site with each of the few tiles of the highest level that has several, and the levels below it, downwards.

    Sites without finite coordinates are left out.
    """
    at = sites.select(F.col(site).alias("_site"), F.col(y).cast("double").alias("_sy"), F.col(x).cast("double").alias("_sx")).distinct()
    at = at.where((F.abs("_sy") < float("inf")) & (F.abs("_sx") < float("inf")))
    # partitions by number: by their bytes a few would do, before each site meets its tiles
    at = at.repartition(max(1, -(-sites.count() // PART_SITES)), "_site")
    top = max(0, len(tree.levels) - 2)
    boxes = tree.levels[top].select("tile", "n", "y0", "y1", "x0", "x1").collect()  # at most ``fan`` rows
    none = F.array().cast("array<struct<tile:bigint,n:bigint,y0:double,y1:double,x0:double,x1:double>>")
    each = F.array(*[F.struct(*[F.lit(v).cast("long" if c in ("tile", "n") else "double").alias(c) for c, v in b.asDict().items()]) for b in boxes]) if boxes else none
    return _met(at.withColumn("_b", F.explode(each)).select("_site", "_sy", "_sx", "_b.*")), list(zip(tree.levels, tree.sizes))[:top][::-1]


def _children(frontier: DataFrame, level: DataFrame, size: int) -> DataFrame:
    """Each (site, tile) with the tile's children of a level."""
    below = level.select(F.col("tile").alias("_child"), F.col("parent").alias("tile"), "n", "y0", "y1", "x0", "x1")
    joined = frontier.join(F.broadcast(below) if size <= BROADCAST_TILES else below.hint("shuffle_merge"), "tile")
    return _met(joined.withColumn("tile", F.col("_child")))


def nearest_points(sites: DataFrame, tree: TileTree, k: int, site: str, sy: str, sx: str, id_: str, y: str, x: str) -> DataFrame:
    """(site, id, d): the k points nearest to each site, ties by id.

    Going down, a site keeps the tiles that begin no farther off than the distance
    within which other kept tiles surely hold k points. A site id must stand for one place.
    """
    met, below = _at_the_top(sites, tree, site, sy, sx)
    by = Window.partitionBy("_site")
    for level, size in [*below, (None, 0)]:
        sure = F.sum("n").over(by.orderBy("far").rangeBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("_reach", F.when(sure >= k, F.col("far"))).withColumn("_reach", F.min("_reach").over(by))
        frontier = met.where(F.coalesce(F.col("near") <= F.col("_reach"), F.lit(True))).select("_site", "_sy", "_sx", "tile")
        if level is not None:
            met = _children(frontier, level, size)
    pairs = frontier.join(tree.points.select("tile", F.col(id_).alias("_id"), F.col(y).alias("_y"), F.col(x).alias("_x")), "tile")
    d = pairs.select("_site", "_id", distance(F.col("_sy") - F.col("_y"), F.col("_sx") - F.col("_x")).alias("d"))
    found = d.withColumn("_n", F.row_number().over(by.orderBy("d", "_id"))).where(F.col("_n") <= k)
    return found.select(F.col("_site").alias(site), F.col("_id").alias(id_), "d")


def met_blocks(blocks: DataFrame, tiles: DataFrame, radius: float) -> DataFrame:
    """(_b, _c, whole): the pairs of a block of sites and a tile of points with a distance within the radius; whole where no distance passes it.

    Both have boxes (tile, y0, y1, x0, x1). Blocks are few by design, so each tile is held against all of them.
    """
    of = blocks.select(F.col("tile").alias("_b"), *[F.col(c).alias(f"_{c}") for c in ("y0", "y1", "x0", "x1")])
    pairs = tiles.select(F.col("tile").alias("_c"), "y0", "y1", "x0", "x1").crossJoin(F.broadcast(of))
    under = {c: (F.col(f"{c}0") - F.col(f"_{c}1"), F.col(f"_{c}0") - F.col(f"{c}1")) for c in "yx"}
    near = distance(*[F.greatest(*under[c], F.lit(0.0)) for c in "yx"])
    far = distance(*[F.greatest(*[F.abs(u) for u in under[c]]) for c in "yx"])
    return pairs.select("_b", "_c", near.alias("_near"), (far <= radius).alias("whole")).where(F.col("_near") <= radius).drop("_near")


def sums_within(sites: np.ndarray, points: np.ndarray, sums: np.ndarray, lows: np.ndarray, radius: float, leaf: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Sums and least values, column by column, of the rows of ``sums`` and ``lows`` whose points lie within the radius of each site.

    Points are halved along their wider axis. A part that lies within a site's circle
    counts as a whole, one that its edge cuts is opened for those sites alone.
    """
    total, least = np.zeros((len(sites), sums.shape[1])), np.full((len(sites), lows.shape[1]), np.inf)
    todo = [(np.arange(len(points)), np.arange(len(sites)))] if len(points) else []
    while todo:
        own, at = todo.pop()
        p, s = points[own], sites[at]
        low, high = p.min(0), p.max(0)
        near = np.maximum(np.maximum(low - s, s - high), 0.0)
        far = np.maximum(np.abs(s - low), np.abs(s - high))
        whole = np.sqrt(far[:, 0] * far[:, 0] + far[:, 1] * far[:, 1]) <= radius
        cut = ~whole & (np.sqrt(near[:, 0] * near[:, 0] + near[:, 1] * near[:, 1]) <= radius)
        if whole.any():
            total[at[whole]] += sums[own].sum(0)
            least[at[whole]] = np.minimum(least[at[whole]], lows[own].min(0))
        if not cut.any():
            continue
        s, at = s[cut], at[cut]
        if len(own) <= leaf:
            for i in range(0, len(at), 4096):
                dy, dx = s[i : i + 4096, :1] - p[:, 0], s[i : i + 4096, 1:] - p[:, 1]
                seen, to = np.sqrt(dy * dy + dx * dx) <= radius, at[i : i + 4096]
                total[to] += seen.astype(float) @ sums[own]
                least[to] = np.minimum(least[to], np.where(seen[:, None, :], lows[own].T, np.inf).min(2))
        else:
            halves = np.argpartition(p[:, np.argmax(high - low)], len(own) // 2)
            todo += [(own[halves[: len(own) // 2]], at), (own[halves[len(own) // 2 :]], at)]
    return total, least


def circle_moments(sites: np.ndarray, cells: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Sites (indices) with a cell within the radius and, as columns of MOMENTS, the moments of those cells' values.

    A row of ``cells`` is y, x and the value's n, mean, squared deviations, least and greatest; n may be 0.
    """
    points, n = cells[:, :2], cells[:, 2]
    some = n > 0
    sound = some & np.isfinite(cells[:, 3:7]).all(1)
    at = np.flatnonzero(sound) if sound.any() else np.arange(1)
    v = np.where(some, cells[:, 3], 0.0)
    # deviations from a middle row, so what is constant has none
    mid = [np.partition(c[at], len(at) // 2)[len(at) // 2] if sound.any() else 0.0 for c in (v, cells[:, 0], cells[:, 1])]
    off = [np.where(some, c - m, 0.0) for c, m in zip((v, cells[:, 0], cells[:, 1]), mid)]
    plain = [np.where(sound, o, 0.0) for o in off]
    squares = [n * o * o for o in plain]
    squares[0] = squares[0] + np.where(sound, cells[:, 4], 0.0)
    # the last column counts values that are no finite numbers, which would spoil the sums of all
    sums = np.column_stack([np.ones(len(n)), n, *[n * o for o in plain], *squares, n * plain[0] * plain[1], n * plain[0] * plain[2], some & ~sound])
    lows = np.where(some[:, None], np.column_stack([cells[:, 5], -cells[:, 6], points[:, 0], -points[:, 0], points[:, 1], -points[:, 1]]), np.inf)
    lows[some & ~sound, :2] = np.inf
    total, least = sums_within(sites, points, sums, lows, radius)
    there = np.flatnonzero(total[:, 0] > 0)
    total, least = total[there], least[there]
    k = total[:, 1]
    few = np.maximum(k, 1)[:, None]
    mean, square = total[:, 2:5] / few, total[:, 5:8] - total[:, 2:5] ** 2 / few
    cross = total[:, 8:10] - total[:, 2:3] * total[:, 3:5] / few
    ends = np.column_stack([s * least[:, j] for j, s in enumerate((1, -1) * 3)])
    # where most digits of a square cancel, deviations are taken from the site's own mean
    for i in np.flatnonzero(((square < 1e-6 * total[:, 5:8]) & (k > 0)[:, None]).any(1) | (total[:, 10] > 0)):
        d = sites[there[i]] - points
        own = np.flatnonzero((np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) <= radius) & some)
        w = n[own]
        with np.errstate(invalid="ignore"):
            mean[i] = [(w * o[own]).sum() / k[i] for o in off]
            rest = [o[own] - m for o, m in zip(off, mean[i])]
            square[i] = [(w * r * r).sum() for r in rest]
            cross[i] = [(w * rest[0] * r).sum() for r in rest[1:]]
        square[i, 0] += cells[own, 4].sum()
        # NaN is the greatest value, as in Spark
        ends[i, :2] = np.fmin.reduce(cells[own, 5]), np.max(cells[own, 6])
    out = np.column_stack([k, mean + mid, np.maximum(square, 0.0), cross, ends])
    out[k == 0, 1:] = np.nan
    return there, out


#: The columns of moments_of, in order.
MOMENTS = ["m_n", "m_v", "m_y", "m_x", "m_vv", "m_yy", "m_xx", "m_vy", "m_vx", "m_v0", "m_v1", "m_y0", "m_y1", "m_x0", "m_x1"]


def moments_of(df: DataFrame, keys: Sequence[str], v: str, y: str, x: str) -> DataFrame:
    """Mergeable moments of values v at places (y, x) per key: n, means, sums of squared and cross deviations, extremes.

    Rows whose v is null count for nothing, but a key with only such rows stays, with n = 0.
    """
    there = F.col(v).isNotNull()
    own = {c: F.when(there, F.col(of).cast("double")) for c, of in (("v", v), ("y", y), ("x", x))}
    n = F.count(F.when(there, 1))
    moments = {"n": n} | {c: F.avg(e) for c, e in own.items()}
    moments |= {c + c: F.var_pop(e) * n for c, e in own.items()} | {f"v{c}": F.covar_pop(own["v"], own[c]) * n for c in "yx"}
    moments |= {f"{c}{i}": f(e) for c, e in own.items() for i, f in enumerate((F.min, F.max))}
    return df.groupBy(*keys).agg(*[e.alias(f"m_{c}") for c, e in moments.items()])


def merged_moments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The moments of all rows of each key together. Deviations are taken from the joint mean, so no large squares cancel."""
    by, n = Window.partitionBy(*keys), F.col("m_n")
    off = {c: F.col(f"m_{c}") - F.try_divide(F.sum(n * F.col(f"m_{c}")).over(by), F.sum(n).over(by)) for c in "vyx"}
    rows = df.withColumns({f"_{c}": e for c, e in off.items()})
    moved = {c: F.sum(F.coalesce(F.col(f"m_{c}") + n * F.col(f"_{c[0]}") * F.col(f"_{c[1]}"), F.lit(0.0))) for c in ("vv", "yy", "xx", "vy", "vx")}
    means = {c: F.try_divide(F.sum(n * F.col(f"m_{c}")), F.sum(n)) for c in "vyx"}
    ends = {f"{c}{i}": f(f"m_{c}{i}") for c in "vyx" for i, f in enumerate((F.min, F.max))}
    return rows.groupBy(*keys).agg(F.sum(n).alias("m_n"), *[e.alias(f"m_{c}") for c, e in (means | moved | ends).items()])
