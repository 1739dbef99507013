"""Joins of boxes by a grid whose cells follow the sizes of the boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import staged


def cell_sizes(boxes: DataFrame, box: str) -> tuple[float, float]:
    """Twice the mean width and height, so that most boxes touch one to four cells however large the plane is."""
    w, h = boxes.agg(F.avg(F.col(box)["x1"] - F.col(box)["x0"]), F.avg(F.col(box)["y1"] - F.col(box)["y0"])).first()
    return 2 * (w or 0.0) or 1.0, 2 * (h or 0.0) or 1.0


def overlapping(boxes: DataFrame, keys: list[str], ident: str, box: str, only: Column | None = None, closed: bool = False) -> DataFrame:
    """Pairs of boxes of one key that overlap, as columns l and r: structs of all columns, l's ident the smaller. Boxes
    that only touch count if ``closed``. Boxes meet in the cells that they touch, and a pair is reported in the cell of
    its lowest common corner only. ``only`` is a further condition on l and r. Null keys and boxes meet nothing."""
    wide, high = cell_sizes(boxes, box)
    span = lambda low, high_, cell: F.sequence(F.floor(F.col(box)[low] / cell), F.floor(F.col(box)[high_] / cell))
    held = boxes.where(F.col(box).isNotNull())
    cut = held.select(*keys, F.struct(*boxes.columns).alias("b"), F.explode(span("x0", "x1", wide)).alias("_cx"), span("y0", "y1", high).alias("_cy")).withColumn("_cy", F.explode("_cy"))
    left, right = cut.withColumnRenamed("b", "l"), cut.withColumnRenamed("b", "r")
    a, b = F.col("l")[box], F.col("r")[box]
    below = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
    meet = (F.col("l")[ident] < F.col("r")[ident]) & below(a["x0"], b["x1"]) & below(b["x0"], a["x1"]) & below(a["y0"], b["y1"]) & below(b["y0"], a["y1"])
    first = (F.col("_cx") == F.floor(F.greatest(a["x0"], b["x0"]) / wide)) & (F.col("_cy") == F.floor(F.greatest(a["y0"], b["y0"]) / high))
    met = left.join(right, [*keys, "_cx", "_cy"]).where(meet & first)
    return (met if only is None else met.where(only)).select("l", "r")


#: Copies of one box that are held in one row, idents of a cell that meet all others of it in one task, and idents in a run
#: of neighbours; idents a block in the mean, below which blocks meet one by one, as runs would cost more than they save.
COPIES, SHARE, RUN, FEW = 256, 8192, 32, 4


def overlapping_ids(boxes: DataFrame, ident: str, box: str) -> DataFrame:
    """(id, other_id), id the smaller, of all boxes that overlap, for tables with many copies of boxes and full cells. Only
    distinct boxes are compared: each stands for blocks of at most COPIES idents, which are paired at the end. The blocks of
    a full cell are dealt out in shares, each of which meets the cell's shares in a task of its own, so tasks stay even. The
    neighbours of a block are cut into sorted runs, and each run comes out with one ident of the block after the other: the
    same run again and again, and ids that stay the same for a run, of which Parquet's encodings keep little."""
    edges = ["x0", "y0", "x1", "y1"]
    held = boxes.where(F.col(box).isNotNull()).select(F.col(ident).alias("_id"), *[F.col(box)[e].alias(e) for e in edges])
    counted = held.groupBy(*edges).agg(F.count(F.lit(1)).alias("_n"))
    block = F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / COPIES)).alias("_block")
    blocks = staged(held.join(counted.hint("merge"), edges).groupBy(*edges, block).agg(F.sort_array(F.collect_list("_id")).alias("ids")), "blocks")
    wide, high = cell_sizes(boxes, box)
    span = lambda low, high_, cell: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high_) / cell))
    cut = blocks.withColumn("_cx", F.explode(span("x0", "x1", wide))).withColumn("_cy", F.explode(span("y0", "y1", high)))
    full = staged(cut.groupBy("_cx", "_cy").agg(F.ceil(F.sum(F.size("ids")) / SHARE).alias("_shares")), "cells")
    cut = cut.join(full.hint("merge"), ["_cx", "_cy"]).withColumn("_share", F.pmod(F.xxhash64(*edges, "_block"), F.col("_shares")))
    tasks = max(1, min(10_000, 4 * (full.agg(F.sum("_shares")).first()[0] or 0)))
    keys = ["_cx", "_cy", "_share"]
    l = cut.select(*keys, *edges, "ids").repartition(tasks, *keys)  # noqa: E741
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)).alias("_share")
    c = F.col
    meet = lambda b: (c("x0") < b["x1"]) & (b["x0"] < c("x1")) & (c("y0") < b["y1"]) & (b["y0"] < c("y1"))
    first = lambda b: (c("_cx") == F.floor(F.greatest(c("x0"), b["x0"]) / wide)) & (c("_cy") == F.floor(F.greatest(c("y0"), b["y0"]) / high))
    if (blocks.agg(F.avg(F.size("ids"))).first()[0] or 0.0) < FEW:
        r = cut.select("_cx", "_cy", each, F.struct(*edges).alias("b"), c("ids").alias("run")).repartition(tasks, *keys)
        runs = l.join(r.hint("merge"), keys).where(meet(c("b")) & first(c("b"))).select("ids", "run")
    else:
        shares = cut.groupBy("_cx", "_cy", "_shares", "_share").agg(F.collect_list(F.struct(*edges, "ids")).alias("held"))
        r = shares.select("_cx", "_cy", each, "held").repartition(tasks, *keys)
        near = F.flatten(F.filter("held", lambda b: meet(b) & first(b))["ids"])
        met = l.join(r.hint("merge"), keys).select("ids", F.sort_array(near).alias("near"))
        starts = F.when(F.size("near") > 0, F.sequence(F.lit(1), F.size("near"), F.lit(RUN)))
        runs = met.select("ids", "near", F.explode(starts).alias("_at")).select("ids", F.slice("near", c("_at"), RUN).alias("run"))
    under = runs.select("run", F.explode("ids").alias("id")).where(c("id") < F.element_at("run", -1))
    return under.select("id", F.explode("run").alias("other_id")).where(c("id") < c("other_id"))
