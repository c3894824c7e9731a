"""Rebuild of all clusters by rounds of assignment and new centroids, without a task that holds a key's vectors."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.durable import checkpointed

#: Vectors of a key that leaders are chosen from in the first round; twice as many in each further one that finds vectors left over.
SEEDS = 256


def leaders(vectors: np.ndarray, threshold: float) -> list[int]:
    """Rows that become centroids: in order, each whose similarity to all leaders before it is under ``threshold``."""
    unit = _unit(vectors)
    chosen: list[int] = []
    for k in range(len(unit)):
        if not chosen or ((unit[chosen] @ unit[k]).max() + 1) / 2 < threshold:
            chosen.append(k)
    return chosen


def _unit(x: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, lengths, out=np.zeros_like(x), where=lengths > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _leaders(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        chosen = leaders(_matrix(table.column("embedding").chunk(0)), threshold) if table.num_rows else []
        picked = table.take(chosen)
        return pa.table({"label": picked.column("label"), "centroid_id": picked.column("vec_id"), "centroid": picked.column("embedding").cast(pa.list_(pa.float64()))})

    return run


def _nearest(threshold: float):
    """Each vector with the closest of its label's centroids, null if none is close enough; ties go to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, vec_id, embedding, centroids = batch.columns
            out: list = [None] * len(batch)
            if len(batch):
                codes = label.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for code in np.unique(codes):
                    at = np.flatnonzero(codes == code)
                    rows = centroids[int(at[0])].as_py()
                    if rows:
                        ids = [r["centroid_id"] for r in rows]
                        close = (_unit(_matrix(embedding.take(pa.array(at)))) @ _unit(np.array([r["centroid"] for r in rows], dtype=np.float64)).T + 1) / 2
                        best = close.argmax(axis=1)
                        for k, i in enumerate(at.tolist()):
                            out[i] = ids[best[k]] if close[k, best[k]] >= threshold else None
            yield pa.RecordBatch.from_arrays([label, vec_id, pa.array(out, pa.int64())], ["label", "vec_id", "centroid_id"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's sum and number of vectors by centroid."""
    for batch in batches:
        if not len(batch):
            continue
        keys = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["label", "centroid_id"])
        groups: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(*(c.to_pylist() for c in keys.columns), strict=True)):
            groups.setdefault(key, []).append(k)
        x = _matrix(batch.column(2))
        rows = [(label, i, len(at), x[at].sum(axis=0).tolist()) for (label, i), at in groups.items()]
        labels, ids, n, sums = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(labels, batch.column(0).type), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], ["label", "centroid_id", "n", "sum"])


def _assigned(vectors: DataFrame, centroids: DataFrame, threshold: float) -> DataFrame:
    """``(label, vec_id, centroid_id)``; a label's centroids meet its vectors as one row, broadcast or joined as their size asks."""
    by_label = centroids.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("centroid_id", "centroid"))).alias("centroids"))
    met = vectors.join(by_label, "label", "left").select("label", "vec_id", "embedding", "centroids")
    return met.mapInArrow(_nearest(threshold), f"label {vectors.schema['label'].dataType.simpleString()}, vec_id long, centroid_id long")


def _more_leaders(vectors: DataFrame, seeds: int, threshold: float) -> DataFrame:
    """Leaders among the first ``seeds`` vectors of each label; each task sends no more of a label than that."""
    first = vectors.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where(F.col("_n") <= seeds).drop("_n")
    shape = f"label {vectors.schema['label'].dataType.simpleString()}, centroid_id long, centroid array<double>"
    return first.groupBy("label").applyInArrow(_leaders(threshold), shape)


def _means(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """The mean vector of each cluster: sums of batches are merged, so a large cluster isn't gathered."""
    kind = vectors.schema["label"].dataType.simpleString()
    parts = vectors.join(assigned.drop("label"), "vec_id").select("label", "centroid_id", "embedding").mapInArrow(_sums, f"label {kind}, centroid_id long, n long, sum array<double>")
    merged = parts.select("label", "centroid_id", "n", F.posexplode("sum").alias("at", "x")).groupBy("label", "centroid_id", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    centroid = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"])
    return merged.groupBy("label", "centroid_id").agg(centroid.alias("centroid"))


def rebuild(vectors: DataFrame, threshold: float = 0.65, rounds: int = 10, seeds: int = SEEDS) -> DataFrame:
    """``(vec_id, label, cluster)``: all vectors clustered anew within their ``label``; a cluster is named by its smallest ``vec_id``.

    Leaders start the clusters.  In each round every vector joins the centroid
    it is most similar to (cosine mapped to 0-1); vectors under ``threshold``
    with all of them get leaders of their own, chosen among the first of them,
    until none is left over; then each centroid becomes the mean of its
    vectors.  It ends when no vector moves, or after ``rounds``.

    Ids are unique, and vectors of a label have one number of components.  A
    vector of zeros is like none and a cluster of its own.  Vectors that are
    null or hold a null or a value that isn't finite, and null ids, are left
    out; a null label is a label.  An empty table gives an empty result.
    """
    kind = vectors.schema["label"].dataType
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = vectors.where(F.col("vec_id").isNotNull() & finite)
    zeros = vectors.where(~F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("vec_id").cast("long").alias("cluster"))
    vectors = vectors.where(F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.struct("label").alias("label"), "embedding")
    # A null label stands in a struct, so that joins find it.
    names = checkpointed(vectors.select("label").distinct().withColumn("code", F.monotonically_increasing_id()))
    vectors = checkpointed(vectors.join(names, "label").select("vec_id", F.col("code").alias("label"), "embedding"))
    centroids = checkpointed(_more_leaders(vectors, seeds, threshold))
    before = None
    for _ in range(rounds):
        tried = seeds
        while True:
            assigned = checkpointed(_assigned(vectors, centroids, threshold))
            left = assigned.where("centroid_id IS NULL")
            if left.isEmpty():
                break
            tried *= 2
            more = _more_leaders(vectors.join(left.select("vec_id"), "vec_id", "left_semi"), tried, threshold)
            # A vector that leads anew takes the place of the centroid that it once gave its id to.
            centroids = checkpointed(centroids.join(more.select("label", "centroid_id"), ["label", "centroid_id"], "left_anti").unionByName(more))
        if before is not None and before.join(assigned, ["label", "vec_id", "centroid_id"], "left_anti").isEmpty():
            break
        before = assigned
        centroids = checkpointed(_means(vectors, assigned))
    smallest = assigned.groupBy("label", "centroid_id").agg(F.min("vec_id").alias("cluster"))
    named = assigned.join(smallest, ["label", "centroid_id"]).join(names.select(F.col("code").alias("label"), F.col("label.label").cast(kind).alias("own")), "label")
    return named.select("vec_id", F.col("own").alias("label"), "cluster").unionByName(zeros)


def cluster_table(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(label, cluster, members, centroid)`` of a clustering as ``rebuild`` returns it."""
    both = members.select("vec_id", "cluster").join(vectors.select("vec_id", "label", "embedding"), "vec_id")
    sized = members.groupBy("label", "cluster").agg(F.count("*").alias("members"))
    named = _means(vectors.select("vec_id", "label", "embedding"), both.select("vec_id", F.col("cluster").alias("centroid_id")))
    return sized.join(named.select(F.col("centroid_id").alias("cluster"), "centroid"), "cluster").select("label", "cluster", "members", "centroid")


def clusters_of(chunks: DataFrame, members: DataFrame, table: DataFrame) -> DataFrame:
    """``(vec_id, cluster, members)``: the cluster of each asked chunk ``(vec_id)`` and its size; chunks in no cluster are left out."""
    return chunks.select("vec_id").distinct().join(members.select("vec_id", "cluster"), "vec_id").join(table.select("cluster", "members"), "cluster").select("vec_id", "cluster", "members")
