"""Quality classification by importance resampling over hashed n-grams.

Two bag-of-n-grams models, of target text (documents labelled good) and of raw
text (all documents), give each document an importance weight: the sum of the
log ratios of its n-grams' probabilities.  Documents are sampled without
replacement in proportion to the weights' exponentials by Gumbel top-k:
standard Gumbel noise is added to the log weights, and the k largest sums stay
(Xie et al., 2023).
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import bytesvec
from .columns import bounded_batches, fresh, scored
from .durable import durable
from .samples import per_class

BUCKETS = 1 << 14
#: Labelled documents of each class that are read at most; half of the good ones fit the target model, the others and the bad ones the size of the sample.
LABELLED = 6000
#: Rejecting a good document counts as so many accepted bad ones when the size of the sample is fitted.
COST_OF_REJECTION = 5
#: How much a threshold may cost beyond the best one, in rejected good documents of the sample.
SLACK = 0.5
_BINS, _FEW = 4096, 10_000

_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[bytesvec.ALNUM] = 1
_KIND[~bytesvec.NOT_SPACE] = 0


def _grams(block: bytesvec.Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, text by text, and their bounds.  Tokens are runs of letters and digits or of other signs."""
    data = bytesvec.LOWER_ASCII[block.data]
    kind = _KIND[data]
    one, other = bytesvec.runs(kind == 1, block.offsets), bytesvec.runs(kind == 2, block.offsets)
    starts, ends = np.sort(np.concatenate([one.starts, other.starts])), np.sort(np.concatenate([one.ends, other.ends]))
    bounds = np.searchsorted(starts, block.offsets)
    hashes = bytesvec.span_hashes(data, starts, ends)
    pairs = bytesvec.mix(hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:]) if len(hashes) else hashes
    # Each token's unigram is followed by the bigram that it starts; a text's last token starts none.
    both = np.zeros(2 * len(hashes), dtype=np.int64)
    both[0::2] = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    both[1:-1:2] = (pairs % np.uint64(BUCKETS)).astype(np.int64)
    kept = np.ones(len(both), dtype=bool)
    last = bounds[1:][np.diff(bounds) > 0] - 1
    kept[2 * last + 1] = False
    return both[kept], np.where(np.diff(bounds, prepend=0) >= 0, 2 * bounds, 0) - np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets over the texts of a task, raw and of the target."""
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        target = batch.column(0).to_numpy(zero_copy_only=False)
        for block in bytesvec.blocks(batch.column(1)):
            grams, bounds = _grams(block)
            counts[0] += np.bincount(grams, minlength=BUCKETS)
            for i in np.flatnonzero(target[block.first : block.first + len(block)]):
                counts[1] += np.bincount(grams[bounds[i] : bounds[i + 1]], minlength=BUCKETS)
    used = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], ["bucket", "raw", "target"])


def _weigh(log_ratio: np.ndarray):
    """Each text's log importance weight, null without n-grams."""

    def run(texts: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        for block in bytesvec.blocks(texts):
            grams, bounds = _grams(block)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            sums = np.zeros(len(block))
            if len(full):
                sums[full] = np.add.reduceat(log_ratio[grams], bounds[:-1][full])
            yield block.first, [pa.array(np.round(sums, 9), mask=sizes == 0)]

    return run


@dataclass
class Sampler:
    """What decides over a document: the models' log ratio for each bucket, and the least key that stays."""

    log_ratio: np.ndarray
    cut: float
    k: int
    seed: int


def _key(weight: str, seed: int) -> Column:
    """Log weight plus standard Gumbel noise drawn from a hash of the id; null without n-grams."""
    uniform = (F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).cast("double") + F.lit(2.0**63 + 1)) / F.lit(2.0**64 + 2**13)
    return F.col(weight) - F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of column ``key``, by counts in ever finer bins."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        keys = keys.where(F.col("key").between(low, high))
        if low == high:
            return low
        width = (high - low) / _BINS
        bin_of = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(_BINS - 1)).alias("bin")
        bins = keys.groupBy(bin_of).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if k <= row["n"]:
                break
            k -= row["n"]
        low, high = row["low"], row["high"]
        if row["n"] <= _FEW:
            return sorted((r[0] for r in keys.where(F.col("key").between(low, high)).select("key").collect()), reverse=True)[k - 1]


def _share_range(good: np.ndarray, bad: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float]:
    """The weights between which a threshold separates the classes about best: each costs no more than the best one and SLACK rejected good values.

    ``stands_for`` is how many labels of all each good and each bad value stands for.
    """
    values = np.unique(np.concatenate([good, bad]))
    edges = np.concatenate([[values[0] - 1], values])
    # A threshold above edges[i] and up to edges[i + 1] rejects the good values up to edges[i] and accepts the bad ones from edges[i + 1].
    costs = COST_OF_REJECTION * stands_for[0] * np.searchsorted(np.sort(good), values) + stands_for[1] * (len(bad) - np.searchsorted(np.sort(bad), values))
    fair = costs <= costs.min() + SLACK * COST_OF_REJECTION * stands_for[0]
    first = last = int(costs.argmin())
    while first and fair[first - 1]:
        first -= 1
    while last + 1 < len(fair) and fair[last + 1]:
        last += 1
    return float(edges[first]), float(edges[last + 1])


def _sample_size(present: DataFrame, low: float, high: float) -> int:
    """The documents above the place between two weights where most lie within a unit of weight, and half of those there.

    The noise is about as wide as such a place, so the draw decides which half
    of it stays.  Ties go to the lower weights.
    """
    width = max(1.0, (high - low) / _FEW)
    place = F.floor((F.col("_weight") - F.lit(low)) / F.lit(width))
    between = present.where((F.col("_weight") > low) & (F.col("_weight") < high)).groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()
    above = present.where(F.col("_weight") >= high).count()
    if not between:
        return above
    most = min(between, key=lambda r: (-r["n"], r["place"]))
    return above + sum(r["n"] for r in between if r["place"] > most["place"]) + most["n"] // 2


def fit(docs: DataFrame, labels: DataFrame, seed: int = 17, share: float | None = None) -> tuple[Sampler, DataFrame]:
    """A sampler for ``docs``, and all documents' weights: ``(doc_id, _weight, key)``.

    The raw model counts all documents; the target model those of a bounded
    sample with ``quality`` 1.  The sample's size k is ``share`` of the
    documents with an n-gram.  Without ``share`` it is the number of documents
    above a weight that separates labelled documents outside the target model
    about best, where documents lie closest; which documents make up the
    sample is drawn.  Each label counts as the labels of its class that it stands for,
    so that the size follows all labels' ratio whatever was read.  Without
    labels of both kinds every document with an n-gram stays.
    """
    wanted = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    labelled = {r["quality"]: r["count"] for r in wanted.groupBy("quality").count().collect()}
    sample = per_class(wanted, "quality", F.xxhash64("doc_id"), LABELLED)
    good = sorted({r["doc_id"] for r in sample if r["quality"] == 1})
    bad = sorted({r["doc_id"] for r in sample if r["quality"] == 0})
    fitted, checked = good[0::2], good[1::2]
    spark = docs.sparkSession
    bounded_batches(spark)
    marks = spark.createDataFrame([(i,) for i in fitted], "doc_id long").withColumn("_target", F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = texts.join(F.broadcast(marks), "doc_id", "left").select(F.coalesce("_target", F.lit(False)), "text")
    counted = marked.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    counts = np.zeros((2, BUCKETS))
    for bucket, raw, target in counted:
        counts[:, bucket] = raw, target
    if counts[1].sum():
        smoothed = counts + 0.5
        log_ratio = np.log(smoothed[1] / smoothed[1].sum()) - np.log(smoothed[0] / smoothed[0].sum())
    else:
        log_ratio = np.zeros(BUCKETS)
    weights = durable(scored(texts, _weigh(log_ratio), {"_weight": DoubleType()}, keep_text=False).select("doc_id", "_weight", _key("_weight", seed).alias("key")))
    present = weights.where("key IS NOT NULL")
    if share is not None:
        k = round(share * present.count())
    else:
        sides = {1: checked, 0: bad}
        classes = spark.createDataFrame([(i, q) for q, ids in sides.items() for i in ids], "doc_id long, quality int")
        seen = present.join(F.broadcast(classes), "doc_id").select("quality", "_weight").collect()
        by_class = {q: np.array([r["_weight"] for r in seen if r["quality"] == q]) for q in (0, 1)}
        if len(by_class[0]) and len(by_class[1]):
            stands_for = labelled[1] / len(checked), labelled[0] / len(bad)
            k = _sample_size(present, *_share_range(by_class[1], by_class[0], stands_for))
        else:
            k = present.count()
    cut = kth_largest(present, k) if k else float("inf")
    return Sampler(log_ratio, cut, k, seed), weights


def classify_quality(docs: DataFrame, labels: DataFrame, seed: int = 17, share: float | None = None) -> DataFrame:
    """``(doc_id, weight, key, kept)`` for every document; ``weight`` is logarithmic, ``kept`` marks the Gumbel top-k sample.

    A null text, or one without a token, has null weight and key and is not
    kept.  Equal keys (rows that repeat an id and a text) are kept or rejected
    together.  Only ``doc_id`` and ``text``, and of the labels ``doc_id`` and
    ``quality``, are read; an empty table gives an empty result.
    """
    sampler, weights = fit(docs, labels, seed, share)
    return weights.select("doc_id", F.col("_weight").alias("weight"), "key", F.coalesce(F.col("key") >= F.lit(sampler.cut), F.lit(False)).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, seed: int = 17, share: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that ``classify_quality`` keeps.

    Texts are weighed once to find the cut and once to apply it: weighing them
    again costs less than writing or shuffling all texts.
    """
    sampler, _ = fit(docs, labels, seed, share)
    name = fresh(docs, "_weight")
    return scored(docs, _weigh(sampler.log_ratio), {name: DoubleType()}).where(_key(name, seed) >= F.lit(sampler.cut)).drop(name)
