"""Polygon zones: containment, choice, bulk assignment and checks.

Polygons are indexed by grid cell, and the candidates of a cell are packed in one row,
so a position needs one equi join on (map, cell) and no regrouping.  The index is a
small dimension; Spark broadcasts it when its measured size allows and shuffles otherwise.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import count_if, ratio

CELL = 512.0
KIND_AREAS = {"bombsite_a": "a", "site_a": "a", "a_site": "a", "bombsite_b": "b", "site_b": "b", "b_site": "b"}


def with_edges(polygons: DataFrame) -> DataFrame:
    """polygons(map_name, zone_id, priority, verification, vertices, min_z, max_z) plus edges and area."""
    e = F.expr("transform(vertices, (v, i) -> named_struct('xi', v.x, 'yi', v.y, 'xj', vertices[(i + size(vertices) - 1) % size(vertices)].x, 'yj', vertices[(i + size(vertices) - 1) % size(vertices)].y))")
    p = polygons.withColumn("edges", e)
    return p.withColumn("area", F.abs(F.expr("aggregate(edges, 0D, (s, e) -> s + (e.xj + e.xi) * (e.yj - e.yi))")) / 2.0)


def contains(edges: str, x: str = "x", y: str = "y") -> str:
    """Even-odd test; a point on an edge or vertex is inside."""
    border = f"exists({edges}, e -> (e.xj - e.xi) * ({y} - e.yi) - (e.yj - e.yi) * ({x} - e.xi) = 0 AND {x} BETWEEN least(e.xi, e.xj) AND greatest(e.xi, e.xj) AND {y} BETWEEN least(e.yi, e.yj) AND greatest(e.yi, e.yj))"
    cross = f"CASE WHEN (e.yi > {y}) <> (e.yj > {y}) THEN {x} < (e.xj - e.xi) * ({y} - e.yi) / (e.yj - e.yi) + e.xi ELSE false END"
    return f"({border} OR aggregate({edges}, false, (s, e) -> s <> ({cross})))"


def cell_index(polygons: DataFrame) -> DataFrame:
    """One row per (map, grid cell) with its candidate polygons; zones still proposed are left out."""
    p = with_edges(polygons.where("verification <> 'proposed'"))
    total = p.groupBy("map_name", "zone_id").agg(F.sum("area").alias("zone_area"))
    p = p.join(total, ["map_name", "zone_id"])

    def cells(axis: str, out: str) -> Column:
        low, high = F.array_min(F.col(f"vertices.{axis}")), F.array_max(F.col(f"vertices.{axis}"))
        return F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL))).alias(out)

    p = p.select("*", cells("x", "gx")).select("*", cells("y", "gy"))
    item = F.struct((-F.col("priority")).alias("rank"), F.col("zone_area").alias("area"), "zone_id", "min_z", "max_z", "edges")
    return p.groupBy("map_name", "gx", "gy").agg(F.collect_list(item).alias("candidates"))


def assign_zones(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Zone of every point(map_name, x, y, z): highest priority, then smallest area, then id."""
    q = points.withColumn("gx", F.floor(F.col("x") / CELL)).withColumn("gy", F.floor(F.col("y") / CELL)).join(cell_index(polygons), ["map_name", "gx", "gy"], "left")
    band = "((c.min_z IS NULL AND c.max_z IS NULL) OR (z IS NOT NULL AND (c.min_z IS NULL OR z >= c.min_z) AND (c.max_z IS NULL OR z <= c.max_z)))"
    hit = F.expr(f"array_min(transform(filter(candidates, c -> {band} AND {contains('c.edges')}), c -> named_struct('rank', c.rank, 'area', c.area, 'zone_id', c.zone_id)))")
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    return q.withColumn("zone_id", F.when(known, hit["zone_id"])).drop("gx", "gy", "candidates")


def assignment_status(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """resolved / unknown / unavailable with the reason, for a whole corpus."""
    maps = polygons.groupBy("map_name").agg(F.bool_or(F.col("verification") != "proposed").alias("verified"))
    q = assign_zones(points, polygons).join(maps, "map_name", "left")
    reason = (F.when(F.col("verified").isNull(), "zone_set_unavailable").when(~F.col("verified"), "zone_geometry_unverified")
              .when(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull(), "position_unavailable"))
    status = F.when(reason.isNotNull(), "unavailable").when(F.col("zone_id").isNull(), "unknown").otherwise("resolved")
    return q.withColumn("zone_status", status).withColumn("zone_reason", reason).withColumn("zone_id", F.when(reason.isNull(), F.col("zone_id"))).drop("verified")


def coverage(assigned: DataFrame) -> DataFrame:
    c = F.col
    g = assigned.groupBy("match_id").agg(F.count("*").alias("population"), count_if(c("x").isNotNull() & c("y").isNotNull() & c("z").isNotNull()).alias("position_available"),
                                         *[count_if(c("zone_status") == s).alias(s) for s in ("resolved", "unknown", "unavailable")])
    return g.withColumn("coverage", ratio(c("resolved"), c("position_available"))).withColumn(
        "status", F.when(c("population") == 0, "unavailable").when(c("unknown") + c("unavailable") > 0, "partial").otherwise("available"))


def polygon_issues(polygons: DataFrame) -> DataFrame:
    """Structural problems of a zone set."""
    p = with_edges(polygons)
    n = "size(vertices)"
    orient = "(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({b}.y - {a}.y) * ({c}.x - {a}.x))"
    on = "({c}.x BETWEEN least({a}.x, {b}.x) AND greatest({a}.x, {b}.x) AND {c}.y BETWEEN least({a}.y, {b}.y) AND greatest({a}.y, {b}.y))"
    v = {"p": "vertices[i]", "q": f"vertices[(i + 1) % {n}]", "r": "vertices[j]", "s": f"vertices[(j + 1) % {n}]"}

    def o(a, b, c):
        return orient.format(a=v[a], b=v[b], c=v[c])

    def touch(a, b, c):
        return f"({o(a, b, c)} = 0 AND {on.format(a=v[a], b=v[b], c=v[c])})"

    proper = f"(signum({o('p', 'q', 'r')}) * signum({o('p', 'q', 's')}) < 0 AND signum({o('r', 's', 'p')}) * signum({o('r', 's', 'q')}) < 0)"
    meets = f"({proper} OR {touch('p', 'q', 'r')} OR {touch('p', 'q', 's')} OR {touch('r', 's', 'p')} OR {touch('r', 's', 'q')})"
    apart = f"NOT (j = i + 1 OR (i = 0 AND j = {n} - 1))"
    pairs = f"flatten(transform(sequence(0, {n} - 2), i -> transform(sequence(i + 1, {n} - 1), j -> CASE WHEN {{0}} THEN concat('{{1}}:', i, ':', j) END)))"
    found = F.expr(f"""array_compact(concat(array(CASE WHEN area = 0 THEN 'zero_area_polygon' END, CASE WHEN min_z > max_z THEN 'inverted_z_bounds' END),
        {pairs.format('vertices[i] = vertices[j]', 'repeated_vertex')}, {pairs.format(f'({apart}) AND {meets}', 'self_intersection')},
        transform(sequence(0, {n} - 1), i -> CASE WHEN vertices[i] = vertices[(i + 1) % {n}] THEN concat('zero_length_edge:', i) END)))""")
    shape = p.select("map_name", "zone_id", F.explode(found).alias("code"))
    twice = polygons.groupBy("map_name", "zone_id").agg(F.count("*").alias("n")).where("n > 1").select("map_name", "zone_id", F.lit("duplicate_zone_id").alias("code"))
    return shape.unionByName(twice)


def grid_coverage(polygons: DataFrame, maps: DataFrame, per_axis: int = 64) -> DataFrame:
    """Share of a regular grid over each calibrated map that falls in any zone."""
    g = maps.where("origin_x IS NOT NULL AND origin_y IS NOT NULL").select("map_name", "origin_x", "origin_y", (F.col("image_width") * F.col("scale")).alias("w"), (F.col("image_height") * F.col("scale")).alias("h"))
    g = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_axis - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(per_axis - 1))).alias("column"))
    pts = g.select("map_name", (F.col("origin_x") + F.col("w") * (F.col("column") + 0.5) / per_axis).alias("x"), (F.col("origin_y") - F.col("h") * (F.col("row") + 0.5) / per_axis).alias("y"), F.lit(None).cast("double").alias("z"))
    return assign_zones(pts, polygons).groupBy("map_name").agg((count_if(F.col("zone_id").isNotNull()) / F.count("*")).alias("coverage"))


def area_class(zone: Column, areas: dict[str, str] | None = None) -> Column:
    """A / B / mid area of a zone name."""
    name = F.replace(F.trim(F.lower(zone)), F.lit(" "), F.lit("_"))
    lookup = {**KIND_AREAS, **(areas or {})}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in lookup.items() for x in kv]), name)
