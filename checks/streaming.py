"""Streaming queries, each equal to its batch form."""

from pyspark.sql import functions as F

from checks import query, sql
from perkwise import schemas
from perkwise.operators.buckets import BucketedTable
from perkwise.session import scratch_path
from perkwise.sources import sample_tables as st
from perkwise.streaming import feeds


def _feed(spark, frame, schema, name):
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return feeds.read_feed(spark, path, schema)


@query("str1_stream_feedback_events", f"""SELECT * FROM {sql.FEEDBACK_EVENTS}
  WHERE event_type IN ('click', 'redeem', 'ignore', 'unsubscribe')""")
def stream_feedback_events(spark, d):
    rows = st.feedback_events(spark, d)
    # Every event arrives twice.
    stream = _feed(spark, rows.unionByName(rows), schemas.FEEDBACK_EVENTS, "feedback-events")
    return feeds.run_once(feeds.ingest_feedback_events(stream, st.REFERENCE_TS), "ingested")


@query("str2_rolling_feedback_stats", f"""SELECT w AS window_start, w + INTERVAL 7 DAY AS window_end,
  CAST(sum(rating) AS BIGINT) AS rating_sum, count(*) FILTER (WHERE thumbs = 'up') AS ups, count(*) AS record_count
  FROM (SELECT *, unnest(generate_series(date_trunc('day', created_at)::TIMESTAMP - INTERVAL 6 DAY,
    date_trunc('day', created_at)::TIMESTAMP, INTERVAL 1 DAY)) AS w FROM {sql.FEEDBACK})
  WHERE w + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY w""")
def rolling_feedback_stats(spark, d):
    stream = _feed(spark, st.feedback(spark, d), schemas.FEEDBACK, "ratings")
    return feeds.run_once(feeds.rolling_feedback_stats(stream), "rolling")


@query("str3_stream_call_metrics", f"""SELECT date_trunc('minute', created_at)::TIMESTAMP AS window_start, model, count(*) AS calls,
  round(sum(latency_ms), 4) AS latency_sum, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM {sql.CALLS}
  WHERE date_trunc('minute', created_at)::TIMESTAMP + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events)
  GROUP BY 1, 2""")
def stream_call_metrics(spark, d):
    stream = _feed(spark, st.llm_calls(spark, d), schemas.LLM_CALLS, "calls")
    out = feeds.run_once(feeds.call_metrics(stream), "call-metrics")
    return out.withColumn("latency_sum", F.round("latency_sum", 4))


def _one_file(rows):
    """The rows as one part, which one task writes and many make."""
    return rows.repartition(1)


def _kept(spark, frame, schema, keys, measure, window_keys, name):
    """The table that a stream keeps: four files one by one, in no order of time, then a restart and a file that comes again."""
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    table = None
    for again in (False, True):
        dealt = frame.withColumn("_file", F.pmod(F.xxhash64(*keys), F.lit(4)))
        rows = _one_file(dealt.filter("_file = 1")) if again else dealt.repartition(4, "_file")
        rows.drop("_file").write.mode("append").parquet(path)
        stream = measure(feeds.once(feeds.read_feed(spark, path, schema, files_per_trigger=1), keys, "60 days"))
        table = table or BucketedTable(spark, scratch_path(spark, f"{name}-table"), window_keys, stream.schema, 8)
        feeds.keep_feed(stream, table, [window_keys[0]], checkpoint).awaitTermination()
    return table.read()


@query("str2_open_feedback_windows", f"""SELECT w AS window_start, w + INTERVAL 7 DAY AS window_end,
  CAST(sum(rating) AS BIGINT) AS rating_sum, count(*) FILTER (WHERE thumbs = 'up') AS ups, count(*) AS record_count
  FROM (SELECT *, unnest(generate_series(date_trunc('day', created_at)::TIMESTAMP - INTERVAL 6 DAY,
    date_trunc('day', created_at)::TIMESTAMP, INTERVAL 1 DAY)) AS w FROM {sql.FEEDBACK}) GROUP BY w""")
def open_feedback_windows(spark, d):
    return _kept(spark, st.feedback(spark, d), schemas.FEEDBACK, ["id"],
                 lambda s: feeds.rolling_feedback_stats(s, delay=None), ("window_start",), "kept-ratings")
