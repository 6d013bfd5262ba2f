"""The streaming form of a query gives what the batch form gives."""

from pyspark.sql import functions as F

from redactlake.streaming import turns as T
from redactlake.streaming.alerts import alert_counts


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.lit(1704067200) + F.col("id") * 3600).cast("timestamp").alias("ts"), F.concat(F.lit("h"), (F.col("id") % 3).cast("string")).alias("host"), F.lit("email").alias("pii_type"), F.when(F.col("id") % 2 == 0, F.lit(False)).alias("third"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = alert_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM alerts").collect())) == sorted(map(tuple, alert_counts(rows).collect()))


def test_turns_end_as_their_events_say():
    def ended(*events):
        state = T.START
        for at, kind, text in events:
            state = T.stepped(state, at, kind, text)
        why, when = (state[6], state[7]) if state[6] else T.due(state, 1 << 40)
        return why, when

    assert ended((30_000, "text", "late")) == ("unanswered", 25_000)
    assert ended((100, "headers", ""), (95_000, "text", "late")) == ("silent", 90_000)
    assert ended((100, "headers", ""), (200, "text", "a"), (40_000, "text", "b")) == ("silent", 30_200)
    assert ended((100, "headers", ""), (200, "text", "a"), (900, "done", "")) == ("settled", 900)
    assert ended((1, "headers", ""), *((i * 20_000, "text", "a") for i in range(1, 12))) == ("ceiling", 210_000)
    assert ended((1, "headers", ""), (5, "reasoning", "x" * 12_000), (9, "text", "a")) == ("deliberation", 5)
    assert T.stepped((1, 1, 1, 0, 0, "ab", "", 0), 2, "text", "c" * 5000)[5] == "c" * 4000


def test_streamed_turns_equal_stored_ones(spark, tmp_path):
    base = 1704067200000
    rows = [(t, n, n * (700 + 9000 * (t % 4)), "headers" if n == 0 else "done" if n == 9 and t % 3 else "text", f"w{n} ") for t in range(12) for n in range(10)]
    rows += [(1000, 0, 0, "headers", "")]  # moves the watermark on
    df = spark.createDataFrame(rows, "turn long, nth long, at long, kind string, text string").withColumn("ts", F.timestamp_millis(F.when(F.col("turn") == 1000, F.lit(base + 10_000_000)).otherwise(F.lit(base) + F.col("at"))))
    df.filter("turn < 1000 AND nth < 5").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
    q = T.turn_stream(stream).writeStream.outputMode("append").format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    df.filter("turn < 1000 AND nth >= 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    df.filter("turn = 1000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = sorted((r.turn, r.ended, r.after_ms, r.n, r.tail) for r in spark.sql("SELECT * FROM turns WHERE turn < 1000").collect())
    want = sorted((r.turn, r.ended, r.after_ms, r.n, r.tail) for r in T.turns(df.filter("turn < 1000")).collect())
    assert got == want, (set(got) - set(want), set(want) - set(got))
