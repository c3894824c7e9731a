"""Streams over files give what the batch operators give on the same signals."""

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import signals as S
from mnemoframe.sources.views import view
from mnemoframe.streaming import signals as T


@pytest.fixture(scope="module")
def arrived(spark, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("signals") / "in")
    signals = view(spark, small, "signals").withColumn("time", F.col("time").cast("timestamp"))
    signals.repartitionByRange(3, "time").sortWithinPartitions("time").write.parquet(folder)
    return folder, spark.read.parquet(folder)


def stream(spark, arrived, **options):
    folder, batch = arrived
    return spark.readStream.schema(batch.schema).options(**options).parquet(folder)


def rows(spark, frame, mode, name, tmp_path):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_counts(spark, arrived, tmp_path):
    wanted = arrived[1].groupBy(F.window("time", "1 hour").alias("w"), "type").agg(F.count("*").alias("n")).select("w.start", "type", "n")
    assert rows(spark, T.counts_by_type(stream(spark, arrived)), "complete", "counts", tmp_path) == sorted(map(tuple, wanted.collect()))


def test_sessions(spark, arrived, tmp_path):
    wanted = arrived[1].groupBy("agent", F.session_window("time", "60 minutes").alias("w")).agg(F.count("*").alias("n")).select("agent", "w.start", "n")
    assert rows(spark, T.sessions(stream(spark, arrived)), "complete", "agents", tmp_path) == sorted(map(tuple, wanted.collect()))


def test_cooldown(spark, arrived, tmp_path):
    wanted = S.cooled_down(arrived[1], ["agent", "type"])
    got = rows(spark, T.cooled_down(stream(spark, arrived), ["agent", "type"], forget="400 days"), "append", "cooled", tmp_path)
    assert got == sorted(map(tuple, wanted.collect()))


def test_repeated_deliveries(spark, arrived, tmp_path):
    twice = stream(spark, arrived).select("id", "time")
    twice = twice.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")
    got = rows(spark, T.first_arrivals(twice), "append", "once", tmp_path)
    assert len(got) == len({g[0] for g in got}) == arrived[1].count()


def test_journal_is_written_once(spark, arrived, tmp_path):
    for _ in range(2):
        assert T.journal(stream(spark, arrived), str(tmp_path / "journal"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "journal")).count() == arrived[1].count()
