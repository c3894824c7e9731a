"""Operators that score each text and pass a table's own columns through."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

#: Rows and bytes of an Arrow batch at most (one longer row is a batch of its own): whole texts are long, and an executor holds several batches at once.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Python tasks of this session take BATCH_ROWS rows or BATCH_BYTES at a time, unless it already bounds them closer.

    The setting is read when a query starts, after the operator has returned,
    so it stays; it changes no query's result.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        setting = f"spark.sql.execution.arrow.{name}"
        own = spark.conf.get(setting)
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(setting, str(most))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(name: str) -> Column:
    """A column by its exact name, which may hold dots and the like."""
    return F.col("`" + name.replace("`", "``") + "`")


def scored(docs: DataFrame, score: Callable[[pa.Array], Iterator[tuple[int, list[pa.Array]]]], fields: dict[str, DataType], keep_text: bool = True) -> DataFrame:
    """``docs`` with further columns that ``score`` makes from the texts, block by block: the block's first row, and its columns.

    Without ``keep_text`` the text itself isn't sent back.
    """
    bounded_batches(docs.sparkSession)
    own = keep_text and isinstance(docs.schema["text"].dataType, StringType)
    passing = [c for c in docs.columns if keep_text or c != "text"]
    shape = StructType([*docs.select(*map(named, passing)).schema.fields, *(StructField(k, v) for k, v in fields.items())])
    sent = [named(c) for c in passing]
    if not own:
        sent.append(F.col("text").cast("string").alias(fresh(docs, "_text")))
    at = passing.index("text") if own else len(passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found in score(batch.column(at)):
                kept = [batch.column(k).slice(first, len(found[0])) for k in range(len(passing))]
                yield pa.RecordBatch.from_arrays([*kept, *found], [f.name for f in shape])

    return docs.select(*sent).mapInArrow(run, shape)
