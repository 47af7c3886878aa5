"""Superpixels: local k-means on colour and place, then islands go to a neighbour so that every segment is one piece.

Centres are a table. A centre serves its own grid cell and the eight around it, so a cell has at most nine candidates; pixels meet
them by their cell, and a round is that join and one average per centre. Only one number per round, the largest shift, reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.operators.components import connected_components, contract
from cubeloom.operators.moments import vector_width
from cubeloom.operators.ranking import number_rows
from cubeloom.session import cut_lineage, drop_folder, output_folder


def slic(
    df: DataFrame,
    channels: str,
    rows: int,
    cols: int,
    n_segments: int = 512,
    compactness: float = 10.0,
    rounds: int = 10,
    connected: bool = True,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Adds seg (from 1) to every given pixel; masked pixels must be filtered out before and never are a centre.

    A segment starts at the given pixel nearest to the middle of its grid cell; cells without pixels have none. Equal distances go to
    the smaller seg. With ``connected`` each segment keeps its largest 4-connected piece (equal sizes: the one that starts first) and
    the other pieces join the neighbouring piece with which they share most pixel sides (see ``join_islands``); groups of pieces that
    touch no segment become segments of their own. An empty table stays empty.
    """
    if n_segments < 1:
        raise ValueError("n_segments is at least 1")
    step = max(1.0, float((rows * cols / n_segments) ** 0.5))
    grid = max(1, round(rows / step)), max(1, round(cols / step))
    scale = compactness / 100.0 / step
    cell = [F.least(F.floor(F.col(c) * g / n), F.lit(g - 1)).cast("int") for c, g, n in zip(("row", "col"), grid, (rows, cols))]
    place = F.array(F.col("row") * F.lit(scale), F.col("col") * F.lit(scale))
    slim = df.select("row", "col", cell[0].alias("gr"), cell[1].alias("gc"), F.concat(place, F.col(channels).cast("array<double>")).alias("x"))
    image = cut_lineage(slim)  # what lies behind the colours runs once
    width = vector_width(image, "x")
    if width == 0:
        return df.withColumn("seg", F.lit(0))
    centres = _start(image, rows / grid[0], cols / grid[1], grid[1])
    for _ in range(rounds):
        candidates, folder = _candidates(centres)
        members = _assign(image, candidates).groupBy("seg").agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(width)]).alias("_x"))
        moved = centres.join(members, "seg", "left").select("seg", "gr", "gc", F.coalesce("_x", "x").alias("x"), _distance(F.coalesce("_x", "x"), F.col("x")).alias("shift"))
        centres = cut_lineage(moved)
        drop_folder(df.sparkSession, folder)
        if centres.agg(F.max("shift")).first()[0] <= tolerance**2:
            break
    candidates, folder = _candidates(centres)
    found = cut_lineage(_assign(image, candidates).select("row", "col", "seg"))
    drop_folder(df.sparkSession, folder)
    if connected:
        found = join_islands(found, cols)
    return df.join(found, ["row", "col"])


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def _start(image: DataFrame, height: float, width: float, across: int) -> DataFrame:
    """centres(seg, gr, gc, x): the pixel nearest to the middle of every cell that has pixels."""
    off = [F.col(c) + 0.5 - (F.col(g) + 0.5) * F.lit(size) for c, g, size in (("row", "gr", height), ("col", "gc", width))]
    order = F.struct((off[0] * off[0] + off[1] * off[1]).alias("d"), "row", "col")
    first = image.groupBy("gr", "gc").agg(F.min_by("x", order).alias("x"))
    return cut_lineage(first.select((F.col("gr") * across + F.col("gc") + 1).cast("int").alias("seg"), "gr", "gc", "x"))


def _candidates(centres: DataFrame) -> tuple[DataFrame, str]:
    """Per cell its at most nine centres, as a written table: Spark sees its size when it chooses the join."""
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    copies = centres.withColumn("_o", F.explode(around))
    served = copies.select((F.col("gr") + F.col("_o.a")).alias("gr"), (F.col("gc") + F.col("_o.b")).alias("gc"), F.struct("seg", "x").alias("centre"))
    folder = output_folder(centres.sparkSession, "superpixel-centres")
    served.groupBy("gr", "gc").agg(F.collect_list("centre").alias("centres")).write.parquet(folder)
    return centres.sparkSession.read.parquet(folder), folder


def _assign(image: DataFrame, candidates: DataFrame) -> DataFrame:
    near = F.transform("centres", lambda c: F.struct(_distance(c["x"], F.col("x")).alias("d"), c["seg"].alias("seg")))
    return image.join(candidates, ["gr", "gc"]).select("row", "col", "x", F.array_min(near)["seg"].alias("seg"))


def join_islands(labelled: DataFrame, cols: int) -> DataFrame:
    """(row, col, seg) with every segment one 4-connected piece.

    Pieces and the borders between them are tables. Every island points to the piece with which it shares most sides (then to the one
    that starts first); what hangs together is contracted. Groups with the main piece of a segment take that segment, the others are
    larger islands and point again, so their number at least halves per round.
    """
    pieces = cut_lineage(connected_components(labelled.select("row", "col", "seg"), cols, 4, value="seg", out="piece"))
    sizes = cut_lineage(pieces.groupBy("seg", "piece").agg(F.count("*").alias("size")))
    main = cut_lineage(sizes.groupBy("seg").agg(F.max_by("piece", F.struct("size", -F.col("piece"))).alias("piece")))
    islands = cut_lineage(sizes.join(main, ["seg", "piece"], "left_anti").select("piece"))
    if islands.isEmpty():
        return pieces.select("row", "col", "seg")
    ways = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    rim = pieces.join(islands, "piece").select(F.col("piece").alias("a"), "row", "col", F.explode(ways).alias("_o"))
    rim = rim.select("a", (F.col("row") + F.col("_o.a")).alias("row"), (F.col("col") + F.col("_o.b")).alias("col"))
    touching = rim.join(pieces.select("row", "col", F.col("piece").alias("b")), ["row", "col"]).filter("a <> b")
    borders = cut_lineage(touching.groupBy("a", "b").agg(F.count("*").alias("sides")))
    members = islands.select("piece", F.col("piece").alias("g"))
    while not borders.isEmpty():
        picks = borders.groupBy("a").agg(F.max_by("b", F.struct("sides", -F.col("b"))).alias("b"))
        roots = cut_lineage(contract(picks.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        # a main piece points nowhere, so a group has at most one
        owned = roots.join(main, F.col("node") == F.col("piece")).select("root", F.col("piece").alias("own"))
        named = cut_lineage(roots.join(owned, "root", "left").select("node", F.coalesce("own", "root").alias("to"), F.col("own").isNull().alias("open")))
        moved = members.join(named, F.col("g") == F.col("node"), "left")
        members = cut_lineage(moved.select("piece", F.coalesce("to", "g").alias("g")))
        left = borders.join(named.filter("open").select(F.col("node").alias("a"), F.col("to").alias("_a")), "a")
        left = left.join(named.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b", "left")
        left = left.select(F.col("_a").alias("a"), F.coalesce("_b", "b").alias("b"), "sides").filter("a <> b")
        borders = cut_lineage(left.groupBy("a", "b").agg(F.sum("sides").alias("sides")))
    given = members.join(main.select("seg", F.col("piece").alias("g")), "g", "left")
    most = main.agg(F.max("seg")).first()[0]
    own = number_rows(given.filter("seg IS NULL").select("g").distinct(), "g", "_i").select("g", (F.col("_i") + most).cast("int").alias("_new"))
    changed = given.join(own, "g", "left").select("piece", F.coalesce("seg", "_new").alias("_seg"))
    return pieces.join(changed, "piece", "left").select("row", "col", F.coalesce("_seg", "seg").cast("int").alias("seg"))
