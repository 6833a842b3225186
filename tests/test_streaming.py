import shutil

from pyspark.sql import functions as F

from quirebase.streaming import sessions


def drained(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_equal_their_batch_twins(spark, sf, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    shutil.copy(f"{sf}/events.parquet", folder / "a.parquet")
    batch = spark.read.parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    for f, name in ((sessions.sessions, "s1"), (sessions.class_counts, "s2")):
        got = drained(spark, f(sessions.events(spark, str(folder))), name)
        assert sorted(map(str, got.collect())) == sorted(map(str, f(batch).collect()))
