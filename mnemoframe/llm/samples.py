"""Bounded, reproducible samples of labelled rows for fitting models on the driver."""

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def per_class(labelled: DataFrame, label: str, order: Column, most: int) -> list[Row]:
    """At most ``most`` rows of each class, those whose 64-bit hash ``order`` is smallest.

    Counts the classes over all rows, keeps the rows whose hash falls under a
    share that leaves about ``1.3 * most`` (and 50) of each class, and cuts
    what arrives to ``most``.  Rows without a label are left out; rows of one
    class and one hash, such as copies, count once among those that are read.
    """
    labelled = labelled.where(F.col(label).isNotNull())
    counts = {row[0]: row[1] for row in labelled.groupBy(label).count().collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (1.3 * most + 50) / n))))
    draw = (order.cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    rows = labelled.withColumn("_draw", draw).where(F.col("_draw") <= F.element_at(share, F.col(label))).dropDuplicates([label, "_draw"]).collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for row in sorted(rows, key=lambda r: r["_draw"]):
        if taken[row[label]] < most:
            taken[row[label]] += 1
            out.append(row)
    return out
