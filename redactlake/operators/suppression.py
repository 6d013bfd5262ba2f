"""Greedy suppression of overlapping boxes within a page, as a fold over its boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suppressed(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """page, n of the boxes (page, n, x, y, w, h, conf) that stay: largest first, a box goes if a kept one covers `share` of the smaller of the two."""
    order = F.struct((-F.col("w") * F.col("h")).alias("rank"), (-F.col("conf")).alias("sure"), "n", "x", "y", "w", "h")
    rows = boxes.groupBy("page").agg(F.array_sort(F.collect_list(order)).alias("boxes"))

    def covers(k, b):
        w = F.least(k["x"] + k["w"], b["x"] + b["w"]) - F.greatest(k["x"], b["x"])
        h = F.least(k["y"] + k["h"], b["y"] + b["h"]) - F.greatest(k["y"], b["y"])
        return (w > 0) & (h > 0) & (w * h >= share * F.least(-k["rank"], -b["rank"]))

    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: covers(k, b)), acc).otherwise(F.array_append(acc, b)))
    return rows.select("page", F.inline(kept)).select("page", "n")
