from pyspark.sql import functions as F

from sampleloom.streaming import live


def events(spark):
    return spark.createDataFrame([(i, "ab"[i % 2], "ab"[i % 3 == 0], float(i), i * 60) for i in range(60)], "k int, p string, t string, v double, s long").withColumn("ts", F.timestamp_seconds("s"))


def write(spark, path):
    df = events(spark)
    for part in range(3):
        df.where(F.col("k") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    return df


def test_confusion_and_windows_equal_batch(spark, tmp_path):
    df = write(spark, str(tmp_path / "in"))
    stream = live.stream_table(spark, str(tmp_path / "in"), df.schema)
    live.drain(live.confusion_stream(stream, "p", "t"), "conf", "complete", str(tmp_path / "c1"))
    assert {tuple(r) for r in spark.table("conf").collect()} == {tuple(r) for r in live.confusion_stream(df, "p", "t").collect()}
    stream = live.stream_table(spark, str(tmp_path / "in"), df.schema)
    live.drain(live.windowed(stream, "ts", "10 minutes", None, ["p"], "v", "2 hours"), "win", "complete", str(tmp_path / "c2"))
    assert {tuple(r) for r in spark.table("win").collect()} == {tuple(r) for r in live.windowed(df, "ts", "10 minutes", None, ["p"], "v").collect()}


def test_sessions(spark, tmp_path):
    df = events(spark).where("k < 10 or k > 40")
    assert live.sessions(df, "ts", "5 minutes", ["p"]).count() == 4


def test_running_zscore(spark, tmp_path):
    df = events(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.stream_table(spark, str(tmp_path / "in"), df.schema)
    live.drain(live.running_zscore(stream, "p", "v", "ts"), "z", "append", str(tmp_path / "c3"))
    rows = spark.table("z").where("p = 'a'").orderBy("ts").collect()
    assert rows[0].z == 0 and abs(rows[2].z - (4 - 2) / (8 / 3) ** 0.5) < 1e-9
