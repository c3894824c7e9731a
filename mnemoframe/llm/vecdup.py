"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group.

1. Equal vectors of one label form a class, which stands for them from then on.
2. Spherical k-means on a bounded sample gives centroids.  A class is at home
   in the cell of its closest centroid, and it also visits each cell whose
   border is so close that a partner at the threshold may live behind it.
3. In each cell of a label, homes are held against homes and visitors, block
   by block, as matrix products.  A pair is counted in one cell only: in that
   of the smaller number of the two that find it.
4. A block returns for each class how many vectors it links with, and only as
   many links as join components; connected components follow from these.

No table of pairs arises: a group of thousands of near copies costs products
of blocks, and each block returns no more rows than it has members.
"""

from collections.abc import Iterator
from math import acos, ceil, radians, sin, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches
from .components import connected_components
from .durable import durable

#: Classes in a cell of the largest label, about, while the number of cells stays under CELLS.
CELL_ROWS, CELLS = 2048, 4096
#: Vectors that centroids are fitted to, at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12
#: How far beyond a border visitors come from, in standard deviations of a random partner's distance.
REACH = 4.0
#: Members of either side of a block.
BLOCK = 2048
#: Pairs this close to the threshold are computed again one by one.
_NEAR = 1e-12


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; a row's largest component is made 1 first, so that no square leaves the range of a double."""
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit rows: each round assigns rows to the closest centroid and turns it to the sum of its rows; an empty one takes the row that fits worst."""
    centroids = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        closeness = x @ centroids.T
        home, fit = closeness.argmax(axis=1), closeness.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        empty = np.flatnonzero(np.bincount(home, minlength=len(centroids)) == 0)
        sums[empty] = x[np.argsort(fit)[: len(empty)]]
        lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        moved = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centroids)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def visits(x: np.ndarray, centroids: np.ndarray, threshold: float, reach: float = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Each row's home, and a table of the cells that it visits (its home among them).

    A row's distance from the border to a centroid c is (x.home - x.c) /
    |home - c|.  A partner at the threshold stands off by the sine of their
    angle, of which a random direction carries one part in the root of the
    dimension along the border's normal; ``reach`` such parts are searched,
    or the whole sine where that is less, beyond which no partner can be.
    """
    closeness = x @ centroids.T
    home = closeness.argmax(axis=1)
    far = sin(acos(max(-1.0, min(1.0, threshold)))) if threshold > 0 else 1.0
    width = far * min(1.0, reach / sqrt(x.shape[1]))
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))[home]
    return home, closeness.max(axis=1, keepdims=True) - closeness <= width * apart


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _placed(centroids: dict[int, np.ndarray], threshold: float, reach: float):
    """A row for each cell that a class visits; that of its home lists them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, copies, vectors = (batch.column(k) for k in range(4))
            widths = np.diff(vectors.offsets.to_numpy())
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                own = vectors.take(pa.array(at))
                x = unit_rows(_rows(own))
                home, table = visits(x, centroids[int(width)], threshold, reach) if int(width) in centroids else (np.zeros(len(x), dtype=np.int64), np.ones((len(x), 1), dtype=bool))
                row, cell = np.nonzero(table)
                seen = [np.flatnonzero(table[i]).astype(np.int32) if c == home[i] else None for i, c in zip(row.tolist(), cell.tolist(), strict=True)]
                kept = [c.take(pa.array(at[row])) for c in (ids, labels, copies)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, own.take(pa.array(row)), pa.array(np.full(len(row), width, dtype=np.int32)), pa.array(cell.astype(np.int32)), pa.array(home[row].astype(np.int32)), pa.array(seen, pa.list_(pa.int32()))],
                    ["cid", "label", "copies", "embedding", "width", "cell", "home", "visited"],
                )

    return run


def _joins(ids_a: np.ndarray, ids_b: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links of a block connect, fewer than it has members."""
    ids, at = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    at_a, at_b, group, out = at[: len(ids_a)], at[len(ids_a) :], np.arange(len(ids)), []
    for i in np.flatnonzero(linked.any(axis=1)):
        others, own = at_b[linked[i]], group[at_a[i]]
        joined, first = np.unique(group[others], return_index=True)
        new = joined != own
        if new.any():
            for other in ids[others[first[new]]].tolist():
                out.append((min(int(ids_a[i]), other), max(int(ids_a[i]), other)))
            group[np.isin(group, joined[new])] = own
    return out


def _compared(threshold: float):
    """``(a, b, links)`` of a block: with b null, class a links with so many vectors more; else a link of two classes."""

    def run(table: pa.Table) -> pa.Table:
        ids, label, copies, width, cell, home = (table.column(c).to_numpy() for c in ("cid", "label", "copies", "width", "cell", "home"))
        is_home, visited = table.column("is_home").to_numpy(zero_copy_only=False), table.column("visited").combine_chunks()
        starts, cells = visited.offsets.to_numpy(), visited.values.to_numpy()
        vectors = table.column("embedding").combine_chunks()
        order = np.lexsort((cell, width, label))
        key = np.column_stack([label, width, cell])[order]
        out: list[tuple] = []
        for rows in np.split(order, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1):
            a, b = rows[is_home[rows]], rows[~is_home[rows]]
            if not len(a) or not len(b):
                continue
            here = cell[a[0]]
            raw_a, raw_b = _rows(vectors.take(pa.array(a))), _rows(vectors.take(pa.array(b)))
            cosine = unit_rows(raw_a) @ unit_rows(raw_b).T
            for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < _NEAR), strict=True):
                x, y = raw_a[i].astype(np.float64), raw_b[j].astype(np.float64)
                exact = np.dot(x, y) / (np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y)))
                cosine[i, j] = exact if np.isfinite(exact) else cosine[i, j]
            linked = cosine >= threshold
            # Of two that are at home here the smaller id counts the pair.  A visitor's pair is counted here unless its
            # own home has the smaller number and is visited by the other.
            linked &= (home[b] != here) | (ids[a][:, None] < ids[b])
            for i in np.flatnonzero(linked.any(axis=1)):
                seen = cells[starts[a[i]] : starts[a[i] + 1]]
                linked[i] &= ~((home[b] < here) & np.isin(home[b], seen))
            more_a, more_b = linked @ copies[b], copies[a] @ linked
            out += [(int(i), None, int(n)) for some, more in ((a, more_a), (b, more_b)) for i, n in zip(ids[some], more, strict=True) if n]
            out += [(i, j, 0) for i, j in _joins(ids[a], ids[b], linked)]
        a, b, links = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    return run


def _centroids(classes: DataFrame, cell_rows: int) -> dict[int, np.ndarray]:
    """Centroids for each length of vectors in a sample of classes, as many as the largest label's classes fill cells; lengths outside the sample have one cell."""
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k = min(max(ceil(largest / cell_rows), 1), CELLS)
    if k == 1:
        return {}
    by_width: dict[int, list] = {}
    for row in classes.select("embedding").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect():
        by_width.setdefault(len(row[0]), []).append(row[0])
    return {width: spherical_kmeans(unit_rows(np.array(rows)), k) for width, rows in by_width.items()}


def _blocks(placed: DataFrame) -> DataFrame:
    """Both sides of each block: homes of a cell (``is_home``), and all that visit it.  Cells of one block are put together."""
    cell = ["label", "width", "cell"]
    counted = placed.groupBy(*cell).agg(F.sum((F.col("home") == F.col("cell")).cast("long")).alias("homes"), F.count("*").alias("visitors"))
    plan = durable(counted.select(*cell, "homes", "visitors", F.ceil(F.col("homes") / BLOCK).cast("int").alias("across"), F.ceil(F.col("visitors") / BLOCK).cast("int").alias("down")).where("homes > 0"))
    few = F.expr("across = 1 AND down = 1")
    alone = plan.where(few).agg(F.sum(F.col("homes") + F.col("visitors"))).first()[0] or 0
    address = F.xxhash64(*cell)
    plan = plan.select(*cell, "across", "down", F.when(few, F.pmod(address, F.lit(max(ceil(alone / BLOCK), 1)))).otherwise(address).alias("bin"))
    rows = placed.join(plan, cell)
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    draw = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    own = [*cell, "cid", "copies", "embedding", "home", "visited"]
    homes = rows.where("home = cell").select("bin", draw("across").alias("i"), span("down").alias("j"), *own, F.lit(True).alias("is_home"))
    others = rows.select("bin", span("across").alias("i"), draw("down").alias("j"), *own, F.lit(False).alias("is_home"))
    return homes.unionByName(others)


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.93, cell_rows: int = CELL_ROWS, reach: float = REACH, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Vectors of one label and length are linked if their cosine, in double
    precision, is ``threshold`` (over 0) or more; ``component_id`` is the
    smallest id reachable over links.  A vector that is null, empty or zero,
    that holds a null or a value that isn't finite, or whose label is null,
    links with nothing.  A row without an id has links but no component, and is
    kept.  Rows that repeat an id are each returned.  Ties need no rule.  Other
    columns are not read; an empty table gives an empty result.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("own_label"), F.col(vector_column).alias("embedding"))
    # Labels of any type become codes that Arrow and numpy can compare; equal codes of different labels are told apart by the class.
    usable = F.coalesce(F.col("own_label").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    good = rows.where(usable)
    grouped = good.groupBy("own_label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    # Class ids are fixed once written; rows without an id have a class of their own kind with a null least id.
    classes = durable(grouped.withColumn("cid", F.monotonically_increasing_id()))
    codes = durable(classes.select("own_label").distinct().withColumn("label", F.monotonically_increasing_id()))
    coded = durable(classes.join(codes, "own_label").select("cid", "label", "copies", "embedding"))
    centroids = _centroids(coded, cell_rows)
    kind = coded.schema["embedding"].dataType.simpleString()
    shape = f"cid long, label long, copies long, embedding {kind}, width int, cell int, home int, visited array<int>"
    placed = durable(coded.mapInArrow(_placed(centroids, threshold, reach), shape))
    blocks = _blocks(placed)
    found = durable(blocks.groupBy("bin", "i", "j").applyInArrow(_compared(threshold), "a long, b long, links long"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("others"))
    components = connected_components(found.where("b IS NOT NULL"))
    labelled = classes.select("cid", "copies", "least").join(components.withColumnRenamed("id", "cid"), "cid", "left").select("cid", "copies", "least", F.coalesce("component_id", "cid").alias("group"))
    smallest = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    figures = labelled.join(smallest, "group").join(links, "cid", "left").select("cid", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    figures = classes.select("cid", "own_label", "embedding").join(figures, "cid").drop("cid")
    joined = good.join(figures, ["own_label", "embedding"]).select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = joined.unionByName(rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select(F.col("vec_id").alias(id_column), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
