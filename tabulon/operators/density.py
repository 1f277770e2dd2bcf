"""Density clustering (DBSCAN) on a grid whose cells have a diagonal of eps.

* All points of a cell with min_points or more are core, and all of them belong together, so no
  pair inside a cell is ever formed, however many rows one cell holds.
* Points of thinner cells are probes: a cell is met by fewer than (neighbour cells x min_points)
  of them, so each point is compared with a bounded list.
* Whether two cells touch is decided on bounding boxes that are split until the answer is certain;
  only boxes with few points compare points.
* Cells are joined into clusters by minimum-label propagation with pointer jumping.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError
from tabulon.plans.longform import ref
from tabulon.plans.stage import stage

MAX_DIMENSIONS = 4
SMALL_BOX = 32
SALTS = 8


def _d2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _offsets(d: int) -> list[tuple[int, ...]]:
    """Cell offsets whose cells can hold points within eps; the cell side is eps / sqrt(d)."""
    reach = math.ceil(math.sqrt(d))
    near = []
    for o in product(range(-reach, reach + 1), repeat=d):
        gap = sum(max(0, abs(v) - 1) ** 2 for v in o)
        if gap <= d:
            near.append(o)
    return near


def _shifted(cell: Column, offset: tuple[int, ...]) -> Column:
    return F.array(*[cell[i] + F.lit(v) for i, v in enumerate(offset)])


def _neighbour_cells(cell: Column, offsets) -> Column:
    return F.array(*[_shifted(cell, o) for o in offsets])


def _grid(df: DataFrame, features: list[str], key: str, eps: float) -> DataFrame:
    side = eps / math.sqrt(len(features))
    x = F.array(*[ref(c).cast("double") for c in features])
    return (
        df.na.drop(subset=features)
        .select(ref(key).alias("id"), x.alias("x"))
        .withColumn("cell", F.transform("x", lambda v: F.floor(v / F.lit(side)).cast("long")))
    )


def _probe_hits(points: DataFrame, counts: DataFrame, offsets, eps2: float, min_points: int) -> DataFrame:
    """(probe, cell, neighbour, n): points within eps of each probe, per dense cell or one by one."""
    thin = points.join(counts.filter(F.col("n") < min_points).select("cell"), "cell", "left_semi")
    lists = (
        thin.select("id", "x", F.explode(_neighbour_cells(F.col("cell"), offsets)).alias("cell"))
        .groupBy("cell")
        .agg(F.collect_list(F.struct(F.col("id").alias("probe"), F.col("x").alias("px"))).alias("probes"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = points.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    met = salted.join(lists, ["cell", "salt"]).join(counts, "cell")
    near = F.filter("probes", lambda p: _d2(p["px"], F.col("x")) <= F.lit(eps2))
    hits = met.select("cell", "id", (F.col("n") >= min_points).alias("dense"), F.explode(near).alias("p"))
    neighbour = F.when(~F.col("dense"), F.col("id"))
    return hits.groupBy(F.col("p.probe").alias("probe"), "cell", neighbour.alias("neighbour")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _boxes(core: DataFrame, cells: DataFrame | None, level: int, side: float) -> DataFrame:
    """Tight boxes of core points, cells cut into 2^level parts per axis; few points are kept as a list."""
    part = F.transform(
        F.col("x"), lambda v: F.floor(v / F.lit(side / 2**level)).cast("long")
    )
    rows = core if cells is None else core.join(cells, "cell", "left_semi")
    d = F.size("x")
    rows = rows.select("cell", part.alias("part"), "x", d.alias("d"))
    dims = core.select("x").first()["x"]
    return rows.groupBy("cell", "part").agg(
        F.array(*[F.min(F.col("x")[i]) for i in range(len(dims))]).alias("lo"),
        F.array(*[F.max(F.col("x")[i]) for i in range(len(dims))]).alias("hi"),
        F.count(F.lit(1)).alias("n"),
    )


def _box_points(core: DataFrame, boxes: DataFrame, level: int, side: float) -> DataFrame:
    """The points of small boxes as a list next to their box."""
    part = F.transform(F.col("x"), lambda v: F.floor(v / F.lit(side / 2**level)).cast("long"))
    few = boxes.filter(F.col("n") <= SMALL_BOX).select("cell", "part")
    lists = (
        core.withColumn("part", part)
        .join(few, ["cell", "part"], "left_semi")
        .groupBy("cell", "part")
        .agg(F.collect_list("x").alias("points"))
    )
    return boxes.join(lists, ["cell", "part"], "left")


def _touching(core: DataFrame, offsets, eps: float, side: float) -> DataFrame:
    """Pairs of neighbouring cells with core points within eps of each other."""
    eps2 = eps * eps
    half = [o for o in offsets if o > tuple(0 for _ in o)]
    cells = core.select("cell").distinct()
    pairs = stage(
        cells.select(F.col("cell").alias("a"), F.explode(_neighbour_cells(F.col("cell"), half)).alias("b")).join(
            cells.select(F.col("cell").alias("b")), "b", "left_semi"
        )
    )
    found, level = None, 0
    open_pairs = pairs.select("a", "b", F.lit(None).cast("array<bigint>").alias("pa"), F.lit(None).cast("array<bigint>").alias("pb"))
    while True:
        used = open_pairs.select(F.col("a").alias("cell")).union(open_pairs.select(F.col("b").alias("cell"))).distinct()
        boxes = stage(_box_points(core, _boxes(core, used, level, side), level, side))
        up = F.transform("part", lambda v: F.floor(v / F.lit(2)).cast("long")) if level else F.lit(None).cast("array<bigint>")
        sized = boxes.withColumn("up", up)

        def side_of(name):
            return sized.select(
                F.col("cell").alias(name), F.col("up").alias(f"p{name}"), F.col("part").alias(f"part_{name}"),
                F.col("lo").alias(f"lo_{name}"), F.col("hi").alias(f"hi_{name}"), F.col("points").alias(f"points_{name}"),
            )

        keys = (["a", "pa"], ["b", "pb"]) if level else (["a"], ["b"])
        left, right = side_of("a"), side_of("b")
        if not level:
            open_pairs, left, right = open_pairs.select("a", "b"), left.drop("pa"), right.drop("pb")
        both = open_pairs.join(left, keys[0]).join(right, keys[1])
        gap = F.zip_with(
            F.zip_with("lo_b", "hi_a", lambda lo, hi: F.greatest(lo - hi, F.lit(0.0))),
            F.zip_with("lo_a", "hi_b", lambda lo, hi: F.greatest(lo - hi, F.lit(0.0))),
            lambda p, q: F.greatest(p, q),
        )
        span = F.zip_with(
            F.zip_with("hi_b", "lo_a", lambda hi, lo: F.abs(hi - lo)),
            F.zip_with("hi_a", "lo_b", lambda hi, lo: F.abs(hi - lo)),
            lambda p, q: F.greatest(p, q),
        )
        square = lambda c: F.aggregate(F.transform(c, lambda v: v * v), F.lit(0.0), lambda s, v: s + v)
        listed = F.col("points_a").isNotNull() & F.col("points_b").isNotNull()
        close = F.exists("points_a", lambda p: F.exists("points_b", lambda q: _d2(p, q) <= F.lit(eps2)))
        verdict = (
            F.when(square(gap) > eps2, F.lit(False)).when(square(span) <= eps2, F.lit(True)).when(listed, close)
        )
        judged = stage(both.select("a", "b", "part_a", "part_b", verdict.alias("touch")))
        edges = judged.filter("touch").select("a", "b").distinct()
        found = edges if found is None else found.unionByName(edges)
        rest = judged.filter(F.col("touch").isNull()).join(edges, ["a", "b"], "left_anti")
        if rest.isEmpty():
            return stage(found.distinct())
        open_pairs = stage(rest.select("a", "b", F.col("part_a").alias("pa"), F.col("part_b").alias("pb")))
        level += 1


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, comp): smallest vertex of each connected component; vertices has v, edges has a and b."""
    links = stage(edges.select("a", "b").union(edges.select("b", "a")))
    labels = stage(vertices.select("v", F.col("v").alias("comp")))
    while True:
        seen = links.join(labels, links["b"] == labels["v"]).groupBy("a").agg(F.min("comp").alias("low"))
        lowered = labels.join(seen, labels["v"] == seen["a"], "left").select(
            "v", F.col("comp").alias("old"), F.least("comp", F.coalesce("low", "comp")).alias("comp")
        )
        lowered = stage(lowered)
        roots = lowered.select(F.col("v").alias("root"), F.col("comp").alias("jump"))
        jumped = stage(
            lowered.join(roots, F.col("comp") == F.col("root"), "left").select(
                "v", F.least("comp", F.coalesce("jump", "comp")).alias("comp"), "old"
            )
        )
        labels = jumped.select("v", "comp")
        if jumped.filter(F.col("comp") != F.col("old")).isEmpty():
            return labels


def dbscan(df: DataFrame, features: list[str], key: str, eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """(key, cluster_id, core): the cluster is named by its smallest core key; noise has cluster_id null.

    A border point within reach of several clusters takes the one with the smallest name.
    """
    if not 1 <= len(features) <= MAX_DIMENSIONS:
        raise AnalysisError(f"between 1 and {MAX_DIMENSIONS} features, got {len(features)}")
    side = eps / math.sqrt(len(features))
    offsets = _offsets(len(features))
    points = stage(_grid(df, features, key, eps))
    counts = stage(points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    hits = stage(_probe_hits(points, counts, offsets, eps * eps, min_points))
    thin_core = (
        hits.groupBy("probe").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_points).select(F.col("probe").alias("id"))
    )
    dense_cells = counts.filter(F.col("n") >= min_points).select("cell")
    core = stage(
        points.join(dense_cells, "cell", "left_semi").unionByName(points.join(thin_core, "id", "left_semi").select("cell", "id", "x"))
    )
    if core.isEmpty():
        return points.select(F.col("id").alias(key), F.lit(None).cast(points.schema["id"].dataType).alias("cluster_id"), F.lit(False).alias("core"))
    touching = _touching(core, offsets, eps, side)
    labels = components(core.select(F.col("cell").alias("v")).distinct(), touching)
    cell_comp = labels.select(F.col("v").alias("cell"), "comp")
    named = core.join(cell_comp, "cell").groupBy("comp").agg(F.min("id").alias("cluster_id"))
    cell_name = stage(cell_comp.join(named, "comp").select("cell", "cluster_id"))
    core_rows = core.join(cell_name, "cell").select("id", "cluster_id", F.lit(True).alias("core"))
    by_cell = hits.filter(F.col("neighbour").isNull()).join(cell_name, "cell").select("probe", "cluster_id")
    by_point = (
        hits.filter(F.col("neighbour").isNotNull())
        .join(thin_core.withColumnRenamed("id", "neighbour"), "neighbour", "left_semi")
        .join(cell_name, "cell")
        .select("probe", "cluster_id")
    )
    border = (
        by_cell.unionByName(by_point)
        .groupBy("probe")
        .agg(F.min("cluster_id").alias("cluster_id"))
        .join(thin_core.withColumnRenamed("id", "probe"), "probe", "left_anti")
        .select(F.col("probe").alias("id"), "cluster_id", F.lit(False).alias("core"))
    )
    clustered = stage(core_rows.unionByName(border))
    noise = points.join(clustered.select("id"), "id", "left_anti").select(
        "id", F.lit(None).cast(points.schema["id"].dataType).alias("cluster_id"), F.lit(False).alias("core")
    )
    return clustered.unionByName(noise).withColumnRenamed("id", key)
