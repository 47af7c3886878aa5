"""Rasters to lines and polygons.

Both outlines are walks over small local states (a pixel and a direction, or a cell side) whose
successor depends on the neighbourhood only. Tiles compute the successors; walks are then ordered
by pointer doubling, so an outline of any length is handled without gathering it in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.functions import geo
from cubeloom.operators.components import connected_components
from cubeloom.operators.skeleton import RING
from cubeloom.operators.tiles import TILE, tile_apply, tile_array
from cubeloom.session import cut_lineage

WALK_SCHEMA = (
    "state long, head long, off long, closed boolean, out long, length long, low long, low_off long"
)


def walk_pieces(state: np.ndarray, succ: np.ndarray) -> pd.DataFrame:
    """Cuts the part of a walk that one tile sees into closed cycles and through-going pieces.

    Every state gets the head of its piece and its offset from it. A closed cycle starts at its
    smallest state. The head row of an open piece also carries where the piece leads (``out``),
    its length, and its smallest state with that one's offset.
    """
    order = np.argsort(state)
    state, succ = state[order], succ[order]
    n = len(state)
    spot = np.minimum(np.searchsorted(state, succ), max(n - 1, 0))
    local = state[spot] == succ if n else np.zeros(0, bool)
    me = np.arange(n)
    prev = me.copy()
    prev[spot[local]] = me[local]
    open_head = np.ones(n, bool)
    open_head[spot[local]] = False
    # smallest state on the way back, over windows that double until they cover a whole cycle
    jump, low, span = prev.copy(), me.copy(), 1
    while span < n:
        low, jump, span = np.minimum(low, low[jump]), jump[jump], span * 2
    low = np.minimum(low, low[jump]) if n else low
    closed = ~open_head[jump]
    start = open_head | (closed & (low == me))
    jump = np.where(start, me, prev)
    off = (~start).astype(np.int64)
    while True:
        step = off[jump]
        if not step.any():
            break
        off, jump = off + step, jump[jump]
    head = jump
    frame = pd.DataFrame({"state": state, "head": state[head] if n else state, "off": off, "closed": closed})
    for name in ("out", "length", "low", "low_off"):
        frame[name] = np.int64(-1)
    tails = np.flatnonzero(~closed & ~local)
    if len(tails):
        rows = head[tails]
        pieces = pd.DataFrame({"head": head, "state": state, "off": off})[~closed]
        least = pieces.loc[pieces.groupby("head")["state"].idxmin()].set_index("head")
        frame.loc[rows, "out"] = succ[tails]
        frame.loc[rows, "length"] = off[tails] + 1
        frame.loc[least.index, "low"] = least["state"].to_numpy()
        frame.loc[least.index, "low_off"] = least["off"].to_numpy()
    return frame


def order_pieces(pieces: DataFrame) -> DataFrame:
    """pieces(state, next, w, low, low_off), a permutation of pieces -> (state, cycle, start, total, shift).

    cycle is the smallest state of the whole walk, start the piece's distance from its anchor (the
    piece with that state), total the walk's length and shift the smallest state's place in the
    anchor. The walks are ordered by pointer doubling.
    """
    pieces = cut_lineage(pieces)
    current = pieces.select("state", F.col("next").alias("jump"), "low")
    while True:
        ahead = current.select(F.col("state").alias("jump"), F.col("jump").alias("_j"), F.col("low").alias("_m"))
        doubled = cut_lineage(
            current.join(ahead, "jump").select(
                "state", F.col("_j").alias("jump"), F.least("low", "_m").alias("low"), (F.col("_m") < F.col("low")).alias("changed")
            )
        )
        settled = doubled.filter("changed").isEmpty()
        current = doubled.drop("changed")
        if settled:
            break
    named = pieces.select("state", "next", "w", F.col("low").alias("own"), "low_off").join(
        current.select("state", F.col("low").alias("cycle")), "state"
    )
    anchors = named.filter(F.col("own") == F.col("cycle")).select("cycle", F.col("state").alias("anchor"), F.col("low_off").alias("shift"))
    named = named.join(anchors, "cycle")
    last = F.col("next") == F.col("anchor")
    rank = cut_lineage(
        named.select(
            "state", "cycle", "anchor", "shift", "w",
            F.when(last, F.col("state")).otherwise(F.col("next")).alias("jump"),
            F.when(last, F.lit(0)).otherwise(F.col("w")).cast("long").alias("left"),
        )
    )
    while True:
        # final pieces point to themselves with nothing left; every piece joins exactly one row
        ahead = rank.select(F.col("state").alias("jump"), F.col("jump").alias("_j"), F.col("left").alias("_l"))
        moved = cut_lineage(
            rank.join(ahead, "jump").select(
                "state", "cycle", "anchor", "shift", "w", F.col("_j").alias("jump"),
                (F.col("left") + F.col("_l")).alias("left"), (F.col("_l") > 0).alias("moved"),
            )
        )
        done = moved.filter("moved").isEmpty()
        rank = moved.drop("moved")
        if done:
            break
    ends = rank.filter(F.col("jump") == F.col("state")).select("cycle", F.col("w").alias("_last"))
    heads = rank.filter(F.col("state") == F.col("anchor")).select("cycle", F.col("left").alias("_all"))
    totals = heads.join(ends, "cycle").select("cycle", (F.col("_all") + F.col("_last")).alias("total"), "_last")
    return rank.join(totals, "cycle").select(
        "state", "cycle", (F.col("total") - F.col("left") - F.col("_last")).alias("start"), "total", "shift"
    )


def order_walks(states: DataFrame) -> DataFrame:
    """Output of :func:`walk_pieces` -> adds cycle (smallest state of the walk) and pos (0 at it).

    Walks inside one tile are already ordered; only pieces that cross tiles are linked up.
    """
    rest = [c for c in states.columns if c not in ("head", "off", "closed", "out", "length", "low", "low_off")]
    inner = states.filter("closed").select(*rest, F.col("head").alias("cycle"), F.col("off").alias("pos"))
    across = states.filter("NOT closed")
    pieces = across.filter("state = head").select("state", F.col("out").alias("next"), F.col("length").alias("w"), "low", "low_off")
    linked = order_pieces(pieces).withColumnRenamed("state", "head")
    place = F.pmod(F.col("start") + F.col("off") - F.col("shift"), F.col("total"))
    outer = across.join(linked, "head").select(*rest, "cycle", place.alias("pos"))
    return inner.unionByName(outer)


def skeleton_to_lines(skeleton: DataFrame, cols: int, gt: geo.GeoTransform, tile: int = TILE) -> DataFrame:
    """lines(id, seq, row, col, x, y): the outline walk around every skeleton part, at least 2 points.

    The walk leaves a pixel by the next neighbour after the one it came from; an open line is
    followed out and back. The corner triangles of diagonal steps are not outlines.
    """

    def successors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["_f"] = np.int8(1)
        image, r0, c0 = tile_array(pdf, "_f", 0, pad=2)
        core = pdf[pdf["core"]]
        r, c = core["row"].to_numpy(), core["col"].to_numpy()
        states, nexts = [], []
        for d, (dr, dc) in enumerate(RING):
            there = image[r + dr - r0, c + dc - c0] == 1
            qr, qc = r[there] + dr, c[there] + dc
            # at the neighbour, turn from the way back to the next occupied direction
            back = (d + 4) % 8
            chosen = np.full(len(qr), -1)
            for turn in range(1, 9):
                e = (back + turn) % 8
                hit = (chosen < 0) & (image[qr + RING[e][0] - r0, qc + RING[e][1] - c0] == 1)
                chosen[hit] = e
            states.append((r[there].astype(np.int64) * cols + c[there]) * 8 + d)
            nexts.append((qr.astype(np.int64) * cols + qc) * 8 + chosen)
        return walk_pieces(np.concatenate(states), np.concatenate(nexts))

    walk = cut_lineage(tile_apply(skeleton.select("row", "col"), successors, WALK_SCHEMA, tile, 2))
    ordered = cut_lineage(order_walks(walk))
    pix = F.floor(F.col("state") / 8)
    row, col = geo.row_of(pix, cols), geo.col_of(pix, cols)
    # three steps enclose a triangle: around a part one way, inside a corner the other way
    first = F.when(F.col("pos") < 3, F.struct("pos", row.alias("r"), col.alias("c")))
    lengths = ordered.groupBy("cycle").agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(first)).alias("_p"))
    a, b, c3 = (F.get("_p", F.lit(i)) for i in range(3))
    area = (b["r"] - a["r"]) * (c3["c"] - a["c"]) - (b["c"] - a["c"]) * (c3["r"] - a["r"])
    lines = ordered.join(lengths.filter((F.col("_n") >= 2) & ((F.col("_n") != 3) | (area < 0))).select("cycle"), "cycle")
    located = lines.select(F.col("cycle").alias("id"), F.col("pos").alias("seq"), row.alias("row"), col.alias("col"))
    r, c = F.col("row"), F.col("col")
    return located.select(
        "id", "seq", "row", "col",
        (F.lit(float(gt[0])) + c * float(gt[1])).alias("x"),
        (F.lit(float(gt[3])) + r * float(gt[5])).alias("y"),
    )


# Cell sides clockwise (top, right, bottom, left): outward step, then the cells met ahead and
# ahead-left of a walk that keeps the cell on its right.
SIDES = (
    ((-1, 0), (0, 1), (-1, 1)),
    ((0, 1), (1, 0), (1, 1)),
    ((1, 0), (0, -1), (1, -1)),
    ((0, -1), (-1, 0), (-1, -1)),
)


def region_sides(classes: DataFrame, cols: int, value: str = "label", tile: int = TILE) -> DataFrame:
    """Exposed cell sides (row, col, side, corner) as pieces of walks around the regions.

    Ahead free: turn around the own cell; ahead taken but ahead-left free: go straight; both
    taken: turn left. So a walk stays inside one 4-connected region. ``corner`` marks a turn.
    """

    def expose(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, r0, c0 = tile_array(pdf, "_v", np.nan, pad=1)
        core = pdf[pdf["core"]]
        r, c = core["row"].to_numpy(), core["col"].to_numpy()
        own = grid[r - r0, c - c0]
        frames = []
        for side, ((dr, dc), (ar, ac), (lr, lc)) in enumerate(SIDES):
            exposed = grid[r + dr - r0, c + dc - c0] != own
            rr, cc, v = r[exposed], c[exposed], own[exposed]
            ahead = grid[rr + ar - r0, cc + ac - c0] == v
            left = ahead & (grid[rr + lr - r0, cc + lc - c0] == v)
            nr = np.where(left, rr + lr, np.where(ahead, rr + ar, rr)).astype(np.int64)
            nc = np.where(left, cc + lc, np.where(ahead, cc + ac, cc)).astype(np.int64)
            ns = np.where(left, (side + 3) % 4, np.where(ahead, side, (side + 1) % 4))
            frames.append(
                pd.DataFrame(
                    {
                        "state": (rr.astype(np.int64) * cols + cc) * 4 + side,
                        "next": (nr * cols + nc) * 4 + ns,
                        "corner": ns != side,
                    }
                )
            )
        sides = pd.concat(frames, ignore_index=True)
        pieces = walk_pieces(sides["state"].to_numpy(), sides["next"].to_numpy())
        return pieces.merge(sides[["state", "corner"]], on="state")

    slim = classes.select("row", "col", F.col(value).cast("double").alias("_v"))
    sides = tile_apply(slim, expose, WALK_SCHEMA + ", corner boolean", tile, 1)
    pix = F.floor(F.col("state") / 4)
    return sides.withColumns(
        {"row": geo.row_of(pix, cols), "col": geo.col_of(pix, cols), "side": F.pmod("state", F.lit(4)).cast("int")}
    )


def polygonize(
    classes: DataFrame,
    cols: int,
    gt: geo.GeoTransform,
    value: str = "label",
    background: int | None = 0,
    names: dict[int, str] | None = None,
    tile: int = TILE,
) -> tuple[DataFrame, DataFrame]:
    """(regions, rings) of the 4-connected equal-value areas of a class grid.

    regions(region, value, name, area, perimeter): area in cells, perimeter in cell sides.
    rings(region, ring, hole, seq, x, y): turning points in walk order; holes wind the other way.
    """
    kept = classes.select("row", "col", F.col(value).alias("value"))
    if background is not None:
        kept = kept.filter(F.col("value") != background)
    labelled = cut_lineage(connected_components(kept, cols, 4, "value", tile=tile, out="region"))
    sides = cut_lineage(region_sides(kept, cols, "value", tile))
    walked = cut_lineage(
        order_walks(sides).join(labelled.select("row", "col", "region"), ["row", "col"])
    )
    perimeters = walked.groupBy("region").agg(F.count("*").alias("perimeter"))
    regions = labelled.groupBy("region", "value").agg(F.count("*").alias("area")).join(perimeters, "region")
    label = F.lit(None).cast("string")
    for key, text in (names or {}).items():
        label = F.when(F.col("value") == key, F.lit(text)).otherwise(label)
    regions = regions.withColumn("name", label)
    side, row, col = F.col("side"), F.col("row"), F.col("col")
    # twice-free shoelace sum: right sides run down, left sides run up
    swept = F.when(side == 1, col + 1).when(side == 3, -col).otherwise(0)
    holes = walked.groupBy("cycle").agg((F.sum(swept) < 0).alias("hole"))
    end_row = row + F.when((side == 1) | (side == 2), 1).otherwise(0)
    end_col = col + F.when((side == 0) | (side == 1), 1).otherwise(0)
    rings = walked.filter("corner").join(holes, "cycle").select(
        "region", F.col("cycle").alias("ring"), "hole", F.col("pos").alias("seq"),
        (F.lit(float(gt[0])) + end_col * float(gt[1])).alias("x"),
        (F.lit(float(gt[3])) + end_row * float(gt[5])).alias("y"),
    )
    return regions, rings


def close_classes(classes: DataFrame, radius: int, value: str = "label", background: int = 0, tile: int = TILE) -> DataFrame:
    """Closing (dilate, then erode, with a disc) of every class into the background.

    The raster counterpart of growing and shrinking polygons: gaps narrower than the disc fill.
    A gap claimed by two classes goes to the smaller value.
    """
    disc = [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if dr * dr + dc * dc <= radius * radius]
    kind = classes.schema[value].dataType.simpleString()

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, r0, c0 = tile_array(pdf, value, background, pad=2 * radius)
        out = grid.copy()

        def shifted(mask: np.ndarray, dr: int, dc: int) -> np.ndarray:
            return np.roll(np.roll(mask, dr, axis=0), dc, axis=1)

        for v in sorted(set(np.unique(grid).tolist()) - {background}, reverse=True):
            mask = grid == v
            grown = np.logical_or.reduce([shifted(mask, dr, dc) for dr, dc in disc])
            closed = np.logical_and.reduce([shifted(grown, dr, dc) for dr, dc in disc])
            out[closed & (grid == background)] = v
        core = pdf[pdf["core"]]
        r, c = core["row"].to_numpy(), core["col"].to_numpy()
        return pd.DataFrame({"row": r, "col": c, value: out[r - r0, c - c0]})

    return tile_apply(classes.select("row", "col", value), close, f"row int, col int, {value} {kind}", tile, 2 * radius)


def smooth_polygons(classes: DataFrame, cols: int, gt: geo.GeoTransform, radius: int = 1, value: str = "label",
                    background: int = 0, **kw) -> tuple[DataFrame, DataFrame]:
    """:func:`polygonize` of the closed class grid."""
    return polygonize(close_classes(classes, radius, value, background), cols, gt, value, background, **kw)
