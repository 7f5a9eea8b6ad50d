"""De-duplication over a stream, against the same over all rows at once."""

import pytest
from pyspark.sql import functions as F

from smelter.operators import dedupe_first
from smelter.streaming import dedupe_stream, first_rows


def arrivals(spark):
    """Rows in order of ``n``; one key holds a third of them, one is NULL in parts."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 0).otherwise(F.when(n % 41 != 0, n % 37))
    return spark.range(900).select(n.alias("n"), key.alias("key"), F.when(n % 5 != 0, "a").alias("kind"), (n * 1.5).alias("v"))


def drain(spark, schema, tmp_path, **options):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    dedupe_stream(stream, ["key", "kind"], str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["n"], **options).awaitTermination()


def test_drained_stream_equals_batch(spark, tmp_path):
    rows = arrivals(spark)
    for low, high in ((0, 20), (20, 500), (500, 900)):  # three runs, each picking up where the last one stopped
        rows.where(F.col("n").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        drain(spark, rows.schema, tmp_path)
    drain(spark, rows.schema, tmp_path)  # nothing new
    got = sorted(map(str, first_rows(spark, str(tmp_path / "out")).collect()))
    assert got == sorted(map(str, dedupe_first(rows, ["key", "kind"], ["n"]).collect())) and any("key=None" in r for r in got)


def test_a_batch_written_again_is_the_same(spark, tmp_path):
    """A commit that is lost makes Spark run its batch once more."""
    rows = arrivals(spark)
    for low, high in ((0, 300), (300, 900)):
        rows.where(F.col("n").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        drain(spark, rows.schema, tmp_path)
    before = sorted(map(str, first_rows(spark, str(tmp_path / "out")).collect()))
    commit = tmp_path / "checkpoint" / "commits" / "1"
    commit.unlink()
    (tmp_path / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    drain(spark, rows.schema, tmp_path)
    assert commit.exists() and sorted(map(str, first_rows(spark, str(tmp_path / "out")).collect())) == before


def test_forgotten_keys_start_anew(spark, tmp_path):
    rows = arrivals(spark).where("n < 1")
    other = arrivals(spark).where("n = 1")
    for part in (rows, other, rows):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        drain(spark, rows.schema, tmp_path, remember=1)
    assert sorted(r["n"] for r in first_rows(spark, str(tmp_path / "out")).collect()) == [0, 0, 1]


def test_empty_arrivals_and_refused_names(spark, tmp_path):
    rows = arrivals(spark)
    for part in (rows.limit(0), rows):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        drain(spark, rows.schema, tmp_path)
    assert first_rows(spark, str(tmp_path / "out")).count() == dedupe_first(rows, ["key", "kind"], ["n"]).count()
    with pytest.raises(ValueError, match="_batch"):
        dedupe_stream(rows.withColumn("_batch", F.lit(1)), ["key"], "x", "y")
    with pytest.raises(ValueError, match="key"):
        dedupe_stream(rows, [], "x", "y")
