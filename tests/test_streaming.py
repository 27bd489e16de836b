from pyspark.sql import functions as F

from perkwise import schemas
from perkwise.operators.buckets import BucketedTable
from perkwise.streaming import feeds


def test_late_and_repeated_events(spark, tmp_path):
    source, kind = str(tmp_path / "in"), "customer_id string, request_id string, event_type string, metadata string, at string"

    def arrive(*rows):
        frame = spark.createDataFrame([("c", r, t, None, at) for r, t, at in rows], kind)
        frame.withColumn("created_at", F.col("at").cast("timestamp")).drop("at").coalesce(1).write.mode("append").parquet(source)

    def take():
        stream = feeds.read_feed(spark, source, schemas.FEEDBACK_EVENTS, files_per_trigger=1)
        out = feeds.ingest_feedback_events(stream, "2024-01-01 00:00:00")
        feeds.write_feed(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(r["request_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive(("1", "click", "2024-01-05 00:00:00"), ("2", "view", "2024-01-05 00:00:00"))
    assert take() == ["1"]
    # A repeat within the delay, a new one, and one that is two days late.
    arrive(("1", "click", "2024-01-05 00:00:00"), ("3", "redeem", "2024-01-05 12:00:00"), ("4", "ignore", "2024-01-02 00:00:00"))
    assert take() == ["1", "3"]


def test_rolling_stats_emit_complete_windows_only(spark, tmp_path):
    rows = [(i, "o", "c", "{}", 1 + i % 5, "up" if i % 3 else "down", "", "", f"2024-01-{1 + i % 20:02d} 12:00:00") for i in range(200)]
    frame = spark.createDataFrame(rows, "id bigint, offer_id string, customer_id string, generated_copy string, rating int, thumbs string, prompt_version string, model_version string, at string")
    frame = frame.withColumn("created_at", F.col("at").cast("timestamp")).drop("at")
    source = str(tmp_path / "in")
    frame.orderBy("created_at").coalesce(1).write.parquet(source)
    out = feeds.run_once(feeds.rolling_feedback_stats(feeds.read_feed(spark, source, schemas.FEEDBACK)), "rolling")
    got = {str(r["window_start"])[:10]: (r["rating_sum"], r["ups"], r["record_count"]) for r in out.collect()}
    batch = frame.groupBy(F.window("created_at", "7 days", "1 day")).agg(
        F.sum("rating"), F.count_if(F.col("thumbs") == "up"), F.count(F.lit(1))
    ).filter(F.col("window.end") <= F.lit("2024-01-20 11:00:00").cast("timestamp"))
    want = {str(r[0]["start"])[:10]: tuple(r)[1:] for r in batch.collect()}
    assert got == want and "2024-01-13" in got and "2024-01-14" not in got


def test_kept_windows_of_several_files(spark, tmp_path):
    columns = "id bigint, offer_id string, customer_id string, generated_copy string, rating int, thumbs string, prompt_version string, model_version string, at string"
    source, state = str(tmp_path / "in"), str(tmp_path / "state")

    def arrive(ids, day):
        rows = [(i, "o", "c", "{}", 1 + i % 5, "up", "", "", f"2024-01-{day:02d} 12:00:00") for i in ids]
        frame = spark.createDataFrame(rows, columns).withColumn("created_at", F.col("at").cast("timestamp")).drop("at")
        frame.coalesce(1).write.mode("append").parquet(source)
        return frame

    def take():
        stream = feeds.once(feeds.read_feed(spark, source, schemas.FEEDBACK, files_per_trigger=1), ["id"], "10 days")
        stats = feeds.rolling_feedback_stats(stream, "1 day", "1 day", None)
        table = BucketedTable(spark, str(tmp_path / "table"), ("window_start",), stats.schema, 4)
        feeds.keep_feed(stats, table, ["window_start"], state).awaitTermination()
        return table, {str(r["window_start"])[8:10]: (r["rating_sum"], r["ups"], r["record_count"]) for r in table.read().collect()}

    arrive(range(10), 20)
    arrive(range(10, 15), 15)
    table, got = take()
    assert got == {"20": (30, 10, 10), "15": (15, 5, 5)}
    commits = table.log().agg(F.max("commit")).first()[0]
    # After a restart: the first file again, a late one within the delay, one beyond it, one more of an open day.
    for ids, day in ((range(10), 20), (range(20, 22), 15), (range(30, 32), 2), (range(40, 45), 20)):
        arrive(ids, day)
    table, got = take()
    assert got == {"20": (45, 15, 15), "15": (18, 7, 7)}
    # A micro-batch that comes again after its commit changes nothing.
    again = spark.createDataFrame([("2024-01-20 00:00:00", 99)], "s string, v bigint").select(
        F.col("s").cast("timestamp").alias("window_start"), F.col("s").cast("timestamp").alias("window_end"),
        *[F.col("v").alias(c) for c in ("rating_sum", "ups", "record_count")])
    assert commits >= 2 and not table.upsert(again, ["window_start"], name="feed-0")


def test_rows_of_one_file_are_made_by_many_tasks(spark, tmp_path):
    from checks.streaming import _one_file

    rows = spark.range(0, 100, 1, 4).withColumn("made_by", F.spark_partition_id())
    _one_file(rows).write.parquet(str(tmp_path / "file"))
    back = spark.read.parquet(str(tmp_path / "file"))
    assert back.select("made_by").distinct().count() == 4 and len(list((tmp_path / "file").glob("*.parquet"))) == 1
