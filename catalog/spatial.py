"""Edges, morphology, components, skeletons and outlines on the grid scene."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query, r6, with_views
from cubeloom.operators import components, skeleton, stencil, vectorize
from cubeloom.plans import structure


def _morph(name: str, column: str, pick: str, iterations: int):
    r = 2 * iterations
    sql = with_views(
        f"""SELECT row, col, {pick}(h) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS {column} FROM
 (SELECT row, col, {pick}({column}) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS h FROM gridv)""",
        "gridv",
    )

    @query(name if iterations == 1 else f"{name}_twice", sql)
    def run(spark, d):
        operator = stencil.erode if name == "erode" else stencil.dilate
        return operator(V.gridv(spark, d).select("row", "col", column), column, 5, iterations)


for _n in (1, 2):
    _morph("erode", "bin_lo", "min", _n)
    _morph("dilate", "bin_hi", "max", _n)

_offsets = "(VALUES (-1), (0), (1))"
_sobel = f"""SELECT row, col, CAST(CASE WHEN e > 10 THEN 255 ELSE e END AS INT) AS edge FROM
 (SELECT row, col, round_even(0.5::DOUBLE * least(abs(dx), 255) + 0.5::DOUBLE * least(abs(dy), 255), 0) AS e FROM
 (SELECT g.row, g.col, sum(n.v * c.i * CASE WHEN r.i = 0 THEN 2 ELSE 1 END) AS dx, sum(n.v * r.i * CASE WHEN c.i = 0 THEN 2 ELSE 1 END) AS dy
  FROM gray g, gdim, {_offsets} r(i), {_offsets} c(i) JOIN gray n ON n.row = CASE WHEN g.row + r.i < 0 THEN 1 WHEN g.row + r.i >= nrows THEN nrows - 2 ELSE g.row + r.i END
   AND n.col = CASE WHEN g.col + c.i < 0 THEN 1 WHEN g.col + c.i >= ncols THEN ncols - 2 ELSE g.col + c.i END GROUP BY g.row, g.col))"""


@query("sobel_edge", with_views(_sobel, "gray", "gdim"))
def sobel_edge(spark, d):
    return stencil.sobel_edge(V.gray(spark, d)).select("row", "col", "edge")


_grad = f"""SELECT g.row, g.col, sum(n.v * c.i * CASE WHEN r.i = 0 THEN 2 ELSE 1 END) AS dx, sum(n.v * r.i * CASE WHEN c.i = 0 THEN 2 ELSE 1 END) AS dy
 FROM gray g, gdim, {_offsets} r(i), {_offsets} c(i) JOIN gray n ON n.row = greatest(0, least(nrows - 1, g.row + r.i)) AND n.col = greatest(0, least(ncols - 1, g.col + c.i)) GROUP BY g.row, g.col"""
_canny = f"""SELECT row, col, CAST(m AS INT) AS magnitude, m > 400 AS strong FROM (SELECT a.row, a.col, a.m,
 CASE WHEN abs(a.dy) < abs(a.dx) * 0.4142135623730951::DOUBLE THEN a.m > coalesce(w.m, 0) AND a.m >= coalesce(e.m, 0)
  WHEN abs(a.dy) > abs(a.dx) * 2.414213562373095::DOUBLE THEN a.m > coalesce(n.m, 0) AND a.m >= coalesce(s.m, 0)
  WHEN (a.dx < 0) = (a.dy < 0) THEN a.m > coalesce(nw.m, 0) AND a.m > coalesce(se.m, 0)
  ELSE a.m > coalesce(ne.m, 0) AND a.m > coalesce(sw.m, 0) END AS peak
 FROM mg a LEFT JOIN mg w ON w.row = a.row AND w.col = a.col - 1 LEFT JOIN mg e ON e.row = a.row AND e.col = a.col + 1
 LEFT JOIN mg n ON n.row = a.row - 1 AND n.col = a.col LEFT JOIN mg s ON s.row = a.row + 1 AND s.col = a.col
 LEFT JOIN mg nw ON nw.row = a.row - 1 AND nw.col = a.col - 1 LEFT JOIN mg se ON se.row = a.row + 1 AND se.col = a.col + 1
 LEFT JOIN mg ne ON ne.row = a.row - 1 AND ne.col = a.col + 1 LEFT JOIN mg sw ON sw.row = a.row + 1 AND sw.col = a.col - 1) WHERE peak AND m > 200"""
_mg = f"mg AS (SELECT row, col, dx, dy, abs(dx) + abs(dy) AS m FROM ({_grad}))"


def _extra(sql: str, *ctes: str, recursive: bool = False) -> str:
    """Adds common table expressions after the views."""
    head, body = sql.rsplit("\n", 1)
    text = head + ",\n" + ",\n".join(ctes) + "\n" + body
    return text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text


def _one(sql: str) -> str:
    return " ".join(sql.split())


@query("canny_candidates", _extra(with_views(_one(_canny), "gray", "gdim"), _mg))
def canny_candidates(spark, d):
    return stencil.canny_candidates(V.gray(spark, d), low=200, high=400)


@query("canny_edge", _extra(
    with_views("SELECT DISTINCT row, col, 255 AS edge FROM grown", "gray", "gdim"), _mg, f"cand AS ({_one(_canny)})",
    "grown AS (SELECT row, col FROM cand WHERE strong UNION SELECT c.row, c.col FROM grown g JOIN cand c ON abs(c.row - g.row) <= 1 AND c.col BETWEEN g.col - 1 AND g.col + 1 AND c.row IN (g.row - 1, g.row, g.row + 1))",
    recursive=True))
def canny_edge(spark, d):
    return structure.canny_edge(V.gray(spark, d), V.GRID_COLS, 200, 400)


# --- wavelets ---

_details = """SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, sum(x * CASE WHEN k < 2 THEN 1 ELSE -1 END) / 4 AS h, sum(x * CASE WHEN l < 2 THEN 1 ELSE -1 END) / 4 AS v,
 sum(x * CASE WHEN (k < 2) = (l < 2) THEN 1 ELSE -1 END) / 4 AS d FROM
 (SELECT r, c, k, l, coalesce(g.v, 0) AS x FROM gdim, range(0, 2000) a(r), range(0, 100) b(c), range(0, 4) kk(k), range(0, 4) ll(l)
  LEFT JOIN gridv g ON g.row = (r + k) % (nrows + (4 - nrows % 4) % 4) - ((4 - nrows % 4) % 4) // 2 AND g.col = (c + l) % 100 WHERE r < nrows + (4 - nrows % 4) % 4) GROUP BY 1, 2"""
_dt = f"dt AS ({_one(_details)})"
_crop = "SELECT row - ((4 - nrows % 4) % 4) // 2 AS row, col"


@query("swt_details", _extra(with_views("SELECT row, col, round(h, 6) + 0.0 AS h, round(v, 6) + 0.0 AS v, round(d, 6) + 0.0 AS d FROM dt", "gridv", "gdim"), _dt))
def swt_details(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    top, bottom, left, right = stencil.swt_padding(rows, cols, 2)
    padded = stencil.swt_pad(g, rows, cols, 2)
    details = stencil.swt_details_haar(padded, rows + top + bottom, cols + left + right, 2)
    return details.select("row", "col", *[r6(c).alias(c) for c in "hvd"])


@query("swt_details_db2")
def swt_details_db2(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    top, bottom, left, right = stencil.swt_padding(rows, cols, 2)
    padded = stencil.swt_pad(g, rows, cols, 2)
    details = stencil.swt_details(padded, rows + top + bottom, cols + left + right, 2, "db2")
    return details.select("row", "col", *[r6(c).alias(c) for c in "hvd"])


_st = f"st AS ({_crop}, round(sqrt(h * h + v * v + d * d), 9) AS s FROM dt, gdim WHERE row - ((4 - nrows % 4) % 4) // 2 BETWEEN 0 AND nrows - 1)"
_otsu = """ot AS (SELECT arg_max(centre, {'v': var, 'b': -bin}) AS cut FROM (SELECT bin, centre, CASE WHEN wt > w THEN w * (wt - w) * (s / w - (st - s) / (wt - w)) * (s / w - (st - s) / (wt - w)) ELSE 0 END AS var FROM
 (SELECT bin, centre, sum(c) OVER o AS w, sum(c * centre) OVER o AS s, sum(c) OVER () AS wt, sum(c * centre) OVER () AS st FROM
  (SELECT bin, any_value(lo) + (bin + 0.5::DOUBLE) * any_value(w) AS centre, count(*)::DOUBLE AS c FROM (SELECT lo, w, CAST(least(255, floor((s - lo) / w)) AS INT) AS bin FROM st, (SELECT min(s) AS lo, (max(s) - min(s)) / 256 AS w FROM st)) GROUP BY bin)
 WINDOW o AS (ORDER BY bin))))"""


@query("swt_edge", _extra(with_views("SELECT CAST(row AS INT) AS row, col, CAST(s >= cut AS INT) AS edge FROM st, ot", "gridv", "gdim"), _dt, _st, _one(_otsu)))
def swt_edge(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    return stencil.swt_edge(g, rows, cols, 2, use_modulus_maxima=False).select("row", "col", "edge")


@query("swt_edge_maxima")
def swt_edge_maxima(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    return stencil.swt_edge(g, rows, cols, 5).select("row", "col", r6("strength").alias("strength"), "edge")


_theta = "pol AS (SELECT row, col, round(sqrt(h * h + v * v), 6) AS m, atan2(v, h) AS th FROM dt)"
_mm = """SELECT a.row, a.col, CASE WHEN greatest(coalesce(l.m, -1), coalesce(r.m, -1)) > a.m THEN 0 ELSE a.m END AS maxima FROM
 (SELECT *, CASE WHEN th >= 0 THEN CAST(floor((th + pi() / 8) / (pi() / 4)) AS INT) % 4 END AS o FROM pol) a
 LEFT JOIN pol l ON l.row = a.row + CASE o WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN -1 END AND l.col = a.col + CASE o WHEN 2 THEN 0 ELSE -1 END
 LEFT JOIN pol r ON r.row = a.row + CASE o WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN -1 WHEN 3 THEN 1 END AND r.col = a.col + CASE o WHEN 2 THEN 0 ELSE 1 END"""


@query("modulus_maxima", _extra(with_views(_one(_mm), "gridv", "gdim"), _dt, _theta))
def modulus_maxima(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    top, bottom, left, right = stencil.swt_padding(rows, cols, 2)
    details = stencil.swt_details_haar(stencil.swt_pad(g, rows, cols, 2), rows + top + bottom, cols + left + right, 2)
    h, v = F.col("h"), F.col("v")
    polar = details.select("row", "col", F.round(F.sqrt(h * h + v * v), 6).alias("m"), F.atan2(v, h).alias("theta"))
    return stencil.modulus_maxima(polar).select("row", "col", "maxima")


# --- components ---

def _closure(source: str, reach: str = "(abs(n.row - w.row) + abs(n.col - w.col)) = 1", same: str = "") -> tuple[str, str, str]:
    """Recursive labels of a sparse pixel set: smallest flat index reachable."""
    return (
        f"fg AS ({source})",
        f"""w AS (SELECT row, col, row::BIGINT * 100 + col AS label{', k' if same else ''} FROM fg UNION SELECT n.row, n.col, w.label{', n.k' if same else ''} FROM w JOIN fg n
 ON n.row BETWEEN w.row - 1 AND w.row + 1 AND n.col BETWEEN w.col - 1 AND w.col + 1 AND n.row IN (w.row - 1, w.row, w.row + 1) AND {reach} {same})""",
        f"cc AS (SELECT row, col, min(label) AS label{', any_value(k) AS k' if same else ''} FROM w GROUP BY row, col)",
    )


_fg = "SELECT row, col FROM gridv WHERE bin = 1"


@query("connected_components", _extra(with_views("SELECT row, col, label FROM cc", "gridv"), *_closure(_fg), recursive=True))
def connected_components(spark, d):
    return components.connected_components(V.gridv(spark, d).filter("bin = 1").select("row", "col"), V.GRID_COLS, tile=32)


@query("connected_components_8", _extra(with_views("SELECT row, col, label FROM cc", "gridv"), *_closure("SELECT row, col FROM gridv WHERE v > 100", "true"), recursive=True))
def connected_components_8(spark, d):
    return components.connected_components(V.gridv(spark, d).filter("v > 100").select("row", "col"), V.GRID_COLS, 8, tile=32)


_size = "sz AS (SELECT label, count(*) AS n FROM cc GROUP BY label)"
_small = "sm AS (SELECT row, col, n FROM cc JOIN sz USING (label) WHERE n < 4)"


@query("remove_small_objects", _extra(with_views("SELECT g.row, g.col, CAST(CASE WHEN sm.n IS NOT NULL THEN 0 ELSE bin END AS INT) AS bin FROM gridv g LEFT JOIN sm USING (row, col)", "gridv"), *_closure(_fg), _size, _small, recursive=True))
def remove_small_objects(spark, d):
    return components.remove_small_objects(V.gridv(spark, d).select("row", "col", "bin"), V.GRID_COLS, 4)


_bg = "SELECT row, col FROM gridv WHERE bin_lo = 0"


@query("remove_small_holes", _extra(with_views("SELECT g.row, g.col, CAST(CASE WHEN sm.n IS NOT NULL THEN 1 ELSE bin_lo END AS INT) AS bin_lo FROM gridv g LEFT JOIN sm USING (row, col)", "gridv"), *_closure(_bg), _size, "sm AS (SELECT row, col, n FROM cc JOIN sz USING (label) WHERE n < 2)", recursive=True))
def remove_small_holes(spark, d):
    return components.remove_small_holes(V.gridv(spark, d).select("row", "col", "bin_lo"), V.GRID_COLS, 2, "bin_lo")


@query("keep_largest_components", _extra(with_views("SELECT row, col, label FROM cc WHERE label IN (SELECT label FROM sz ORDER BY n DESC, label LIMIT 5)", "gridv"), *_closure("SELECT row, col FROM gridv WHERE v > 100", "true"), _size, recursive=True))
def keep_largest_components(spark, d):
    labelled = components.connected_components(V.gridv(spark, d).filter("v > 100").select("row", "col"), V.GRID_COLS, 8)
    return components.keep_largest_components(labelled, 5)


@query("batch_clean")
def batch_clean(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    return structure.batch_clean(g.select("row", "col", "bin_lo"), rows, cols, 0, 3, 0, 3, 20, 20, "bin_lo")


# --- skeletons and outlines ---

def thick(spark, d):
    """Connected foreground: the sparse pixels grown by one."""
    grown = stencil.dilate(V.gridv(spark, d).select("row", "col", "bin_hi"), "bin_hi", 3)
    return grown.filter("bin_hi = 1").select("row", "col")


@query("skeletonize")
def skeletonize(spark, d):
    return skeleton.skeletonize(thick(spark, d))


@query("prune_branches")
def prune_branches(spark, d):
    return skeleton.prune_branches(skeleton.skeletonize(thick(spark, d)), V.GRID_COLS, 4)


@query("keep_main_skeleton")
def keep_main_skeleton(spark, d):
    return skeleton.keep_main_skeleton(thick(spark, d), V.GRID_COLS, 4, 2)


@query("skeleton_to_lines")
def skeleton_to_lines(spark, d):
    return vectorize.skeleton_to_lines(skeleton.skeletonize(thick(spark, d)), V.GRID_COLS, V.GT)


def classes(spark, d):
    v = F.col("v")
    return V.gridv(spark, d).select("row", "col", F.when(v > 120, 2).when(v > 60, 1).otherwise(0).alias("label"))


_cls = "SELECT row, col, CASE WHEN v > 120 THEN 2 ELSE 1 END AS k FROM gridv WHERE v > 60"
_peri = "pe AS (SELECT cc.label, count(*) AS perimeter FROM cc, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(dr, dc) LEFT JOIN fg n ON n.row = cc.row + dr AND n.col = cc.col + dc AND n.k = cc.k WHERE n.k IS NULL GROUP BY cc.label)"


@query("polygonize", _extra(with_views("SELECT label AS region, k AS value, CASE k WHEN 1 THEN 'metamorphic' ELSE 'sedimentary' END AS name, count(*) AS area, any_value(perimeter) AS perimeter FROM cc JOIN pe USING (label) GROUP BY label, k", "gridv"), *_closure(_cls, same="AND n.k = w.k"), _peri, recursive=True).replace("(abs(n.row", "(abs(n.row"))
def polygonize(spark, d):
    regions, _ = vectorize.polygonize(classes(spark, d), V.GRID_COLS, V.GT, names={1: "metamorphic", 2: "sedimentary"})
    return regions.select("region", "value", "name", "area", "perimeter")


_corner = """co AS (SELECT c.label, CAST(sum(CASE WHEN v.k IS NULL AND h.k IS NULL THEN 1 WHEN v.k IS NOT NULL AND h.k IS NOT NULL AND x.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_points
 FROM cc c, (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) o(dr, dc) LEFT JOIN fg v ON v.row = c.row + dr AND v.col = c.col AND v.k = c.k
 LEFT JOIN fg h ON h.row = c.row AND h.col = c.col + dc AND h.k = c.k LEFT JOIN fg x ON x.row = c.row + dr AND x.col = c.col + dc AND x.k = c.k GROUP BY c.label)"""


@query("polygonize_rings", _extra(with_views("SELECT label AS region, n_points, area::DOUBLE AS area FROM co JOIN (SELECT label, count(*) AS area FROM cc GROUP BY label) USING (label)", "gridv"), *_closure(_cls, same="AND n.k = w.k"), _one(_corner), recursive=True))
def polygonize_rings(spark, d):
    """Turning points per region, and its area by the shoelace sum over all of its rings."""
    _, rings = vectorize.polygonize(classes(spark, d), V.GRID_COLS, V.GT)
    ring = Window.partitionBy("ring").orderBy("seq")
    whole = Window.partitionBy("ring")
    col, row = (F.col("x") - V.GT[0]) / V.GT[1], (F.col("y") - V.GT[3]) / V.GT[5]
    points = rings.select("region", "ring", "seq", col.alias("c"), row.alias("r"))
    nc = F.coalesce(F.lead("c").over(ring), F.min_by("c", "seq").over(whole))
    nr = F.coalesce(F.lead("r").over(ring), F.min_by("r", "seq").over(whole))
    swept = points.withColumn("_a", F.col("c") * nr - nc * F.col("r"))
    return swept.groupBy("region").agg(F.count("*").alias("n_points"), (F.sum("_a") / 2).alias("area"))


@query("smooth_polygons")
def smooth_polygons(spark, d):
    regions, _ = vectorize.smooth_polygons(classes(spark, d), V.GRID_COLS, V.GT, 1)
    return regions.select("region", "value", "area", "perimeter")
