"""Weather-grid operators: issue selection, source alignment, interpolation to sites, field statistics, physics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..sources.tables import ranged, stored, with_part
from .tiles import MOMENTS, circle_moments, merged_moments, met_blocks, moments_of, nearest_points, tile_tree


def asof_issue(targets: DataFrame, forecasts: DataFrame, key: str, t: str, issue: str, value: str, tie: str) -> DataFrame:
    """For each target row the newest forecast of its key issued at or before ``t`` (null if none).

    Both sides are sorted together into ranges of (key, time); at equal times forecasts
    come before targets, and of equal forecasts the one with the greater ``tie``, then
    value, wins. Each range takes over the last forecast of the ranges before it, so a
    key of any size is many tasks. Null keys match nothing; forecasts without a time
    don't count; targets without one get null.
    """
    kinds = {c: forecasts.schema[c].dataType for c in (issue, value)}
    none = F.lit(None)
    left = targets.select(F.col(key), F.col(t).alias("_t"), F.col(tie).alias("_tie"), F.lit(1).alias("_side"), none.cast(kinds[issue]).alias("issued"), none.cast(kinds[value]).alias("issued_value"))
    right = forecasts.where(F.col(key).isNotNull() & F.col(issue).isNotNull()).select(F.col(key), F.col(issue).alias("_t"), F.col(tie).alias("_tie"), F.lit(0).alias("_side"), F.col(issue).alias("issued"), F.col(value).alias("issued_value"))
    order = ["_t", "_side", "_tie", "issued_value"]
    parts = ranged(left.unionByName(right), *map(F.col, [key, *order]))
    of_part = parts.groupBy(key, "_part").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_tie", "issued_value", "issued"))).alias("_end"))
    across = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = of_part.select(F.col(key).alias("_group"), F.col("_part").alias("__part"), F.last("_end", ignorenulls=True).over(across).alias("_carry"))
    by = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_side") == 0, F.struct("issued", "issued_value")), ignorenulls=True).over(by)
    both = with_part(parts.withColumn("_own", found).where("_side = 1"), carried, key)
    latest = F.coalesce("_own", F.when(F.col("_carry").isNotNull(), F.struct("_carry.issued", "_carry.issued_value")))
    return both.withColumn("_f", latest).select(key, F.col("_t").alias(t), F.col("_tie").alias(tie), F.col("_f.issued").alias("issued"), F.col("_f.issued_value").alias("issued_value"))


def align_sources(fc: DataFrame, key: str, valid: str, sources: Sequence[str], cols: Sequence[str], src: str = "src") -> DataFrame:
    """One row per place and valid time with each source's columns and the differences from the first source."""
    cells = [F.max(F.when(F.col(src) == s, F.col(c))).alias(f"{c}_{s}") for s in sources for c in cols]
    wide = fc.where(F.col(src).isin(list(sources))).groupBy(key, valid).agg(*cells)
    return wide.select("*", *[(F.col(f"{c}_{s}") - F.col(f"{c}_{sources[0]}")).alias(f"{c}_{s}_diff") for s in sources[1:] for c in cols])


def cell_weights(sites: DataFrame, grid: DataFrame, k: int, power: float, leaf: int = 64, fan: int = 16) -> DataFrame:
    """(site, cell, weight): inverse-distance weights of the k nearest cells, by distance then cell; a cell at distance 0 stands alone.

    Cells are found down a tree of tiles (tiles.py), so a site meets a few tiles of a
    large grid. Sites and cells without finite coordinates take no part; a site's rows
    must agree on its place.
    """
    tree = tile_tree(grid.select("cell", "gy", "gx"), "cell", "gy", "gx", leaf, fan)
    near = nearest_points(sites, tree, k, "site", "sy", "sx", "cell", "gy", "gx")
    by = Window.partitionBy("site")
    w = F.when(F.min("d").over(by) == 0, (F.col("d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.pow("d", F.lit(power))))
    return near.select("site", "cell", w.alias("weight")).where("weight > 0")


def grid_to_site(sites: DataFrame, grid: DataFrame, field: DataFrame, k: int, power: float, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Field columns at the sites; weights are renormalised over the cells that are present."""
    w = cell_weights(sites, grid, k, power)
    means = [F.try_divide(F.sum(F.when(F.col(c).isNotNull(), F.col("weight") * F.col(c))), F.sum(F.when(F.col(c).isNotNull(), F.col("weight")))).alias(c) for c in cols]
    return field.join(w, "cell").groupBy("site", *by).agg(*means, F.count(F.lit(1)).alias("n_cells"))


def field_stats(sites: DataFrame, grid: DataFrame, field: DataFrame, radius: float, col: str, by: Sequence[str], leaf: int = 64, fan: int = 16, block_sites: int = 256, group_points: int = 1 << 20) -> DataFrame:
    """Mean, spread, least, greatest and the slopes in y and x of a field within ``radius`` of each site.

    Sites are cut into blocks of neighbours, at most some 64 of them while a block stays
    below 2^16 sites, and cells into the tiles of a tree. Tiles that lie wholly within the
    radius of a whole block give their stored moments. The others travel to the blocks
    whose circles may cut them, at most ``group_points`` places or so a task, where each
    block's circles are summed up at once: so what is exchanged grows as the sites and
    cells, not as their pairs. Null values count for nothing (a site with only such values
    has null statistics); slopes are null where all cells share the coordinate.
    """
    keys = list(by)
    tree = tile_tree(grid.select("cell", "gy", "gx"), "cell", "gy", "gx", leaf, fan)
    n_sites = sites.count()
    blocks = tile_tree(sites.select("site", "sy", "sx").distinct(), "site", "sy", "sx", max(block_sites, min(-(-n_sites // 64), 1 << 16)), fan)
    # tiles of some 16,384 cells, two levels up, or the highest
    up = min(2, len(tree.levels) - 1)
    met = stored(met_blocks(blocks.levels[0], tree.levels[up], radius), "met")
    values = field.select("cell", *keys, F.col(col).alias("_v"))
    tile = F.expr(f"tile div {tree.fan**up}").alias("_c")
    # one row for each place and key
    cells = stored(moments_of(values.join(tree.points.select("cell", "gy", "gx", tile), "cell"), ["cell", "gy", "gx", "_c", *keys], "_v", "gy", "gx"), "cells")
    at = blocks.points.select(F.col("tile").alias("_b"), "site", "sy", "sx")
    whole = merged_moments(cells.join(F.broadcast(met.where("whole").select("_c").distinct()), "_c"), ["_c", *keys])
    of_block = merged_moments(met.where("whole").select("_b", "_c").join(whole, "_c"), ["_b", *keys])
    found = at.join(of_block, "_b").select("site", *keys, *MOMENTS)
    # runs of tiles: eight while they keep to the bound, so that a site has few parts to join
    sizes = cells.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("tiles")).first()
    run = max(1, min(-(-(sizes["tiles"] or 1) // 8), group_points // (sizes["most"] or 1)))
    # a tile with more places and keys than the bound is dealt by key
    salts = -(-(sizes["most"] or 1) // group_points)
    salt = (F.pmod(F.xxhash64(*keys), F.lit(salts)) if keys else F.lit(0).cast("long")).alias("_s")
    cut = met.where("not whole").withColumn("_r", F.expr(f"_c div {run}"))
    tasks = stored(cut.select("_b", "_r").distinct().withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), "tasks")
    parts = max(sites.sparkSession.sparkContext.defaultParallelism, tasks.count())
    group = ["_b", "_r", "_s"]
    circles = at.join(F.broadcast(tasks), "_b").select(*group, "site", "sy", "sx").repartition(parts, *group)
    places = cells.join(F.broadcast(cut.select("_b", "_c", "_r")), "_c").select("_b", "_r", salt, *keys, "gy", "gx", *[f"m_{c}" for c in ("n", "v", "vv", "v0", "v1")]).repartition(parts, *group)
    shape = StructType([found.schema[c] for c in ("site", *keys)] + [StructField(c, LongType() if c == "m_n" else DoubleType()) for c in MOMENTS])

    def run_group(at: pa.Table, cells: pa.Table) -> pa.Table:
        of, own = _matrix(at, ["sy", "sx"]), _matrix(cells, ["gy", "gx", "m_n", "m_v", "m_vv", "m_v0", "m_v1"])
        code = cells.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys and len(own) else np.zeros(len(own), int)
        order = np.argsort(code, kind="stable")
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(own) else []:
            there, moments = circle_moments(of, own[rows], radius)
            key = [cells.column(k).take(pa.array(np.full(len(there), rows[0]))) for k in keys]
            sums = [pa.array(m.astype(np.int64) if c == "m_n" else m, mask=None if c == "m_n" else moments[:, 0] == 0) for c, m in zip(MOMENTS, moments.T)]
            out.append(pa.Table.from_arrays([at.column("site").take(pa.array(there)), *key, *sums], ["site", *keys, *MOMENTS]))
        none = pa.Table.from_arrays([at.column("site").slice(0, 0), *[cells.column(k).slice(0, 0) for k in keys], *[pa.array([], pa.int64() if c == "m_n" else pa.float64()) for c in MOMENTS]], ["site", *keys, *MOMENTS])
        return pa.concat_tables(out) if out else none

    parted = circles.groupBy(*group).cogroup(places.groupBy(*group)).applyInArrow(run_group, shape)
    m = merged_moments(found.unionByName(parted), ["site", *keys])
    slope = lambda c: F.when(F.col(f"m_{c}0") < F.col(f"m_{c}1"), F.try_divide(F.col(f"m_v{c}"), F.col(f"m_{c}{c}")))
    spread = F.when(F.col("m_n") > 0, F.sqrt(F.try_divide(F.col("m_vv"), F.col("m_n"))))
    return m.select("site", *keys, F.col("m_v").alias("mean"), spread.alias("spread"), F.col("m_v0").alias("least"), F.col("m_v1").alias("greatest"), slope("y").alias("slope_y"), slope("x").alias("slope_x"))


def _matrix(table: pa.Table, cols: Sequence[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy().astype(float) for c in cols])


def wind_physics(df: DataFrame, u: str, v: str, temp: str | None = None, pressure: str | None = None, z_from: float = 10.0, z_to: float = 100.0, alpha: float = 0.143) -> DataFrame:
    """Speed, direction as sine and cosine, cubed and height-adjusted speed, and density-weighted power where temperature and pressure are given."""
    u_, v_ = F.col(u), F.col(v)
    speed = F.sqrt(u_ * u_ + v_ * v_)
    out = df.withColumn("speed", speed)
    s = F.col("speed")
    cols = {"dir_sin": F.try_divide(v_, s), "dir_cos": F.try_divide(u_, s), "speed3": s * s * s, "speed_hub": s * F.lit((z_to / z_from) ** alpha)}
    if temp and pressure:
        cols["power_density"] = F.lit(0.5) * F.try_divide(F.col(pressure), F.lit(287.05) * F.col(temp)) * s * s * s
    return out.withColumns(cols)
