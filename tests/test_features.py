import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perkwise import schemas
from perkwise.operators import features as fe
from perkwise.sources.generators import CHANNELS, EVENT_TYPES, generate_events

REF = "2024-02-15 00:00:00"


def events(spark, rows):
    frame = spark.createDataFrame(rows, "customer_id string, event_type string, ts string, amount double, offer_id string, channel string")
    return frame.select("customer_id", "event_type", F.col("ts").cast("timestamp").alias("timestamp"), "amount", "offer_id", "channel")


def one(df, customer):
    return df.filter(F.col("customer_id") == customer).first()


def test_recency_counts_elapsed_days_not_calendar_days(spark):
    out = fe.rfm(events(spark, [
        ("a", "app_open", "2024-02-14 00:00:01", None, None, "web"),
        ("b", "app_open", "2024-02-14 00:00:00", None, None, "web"),
        ("c", "app_open", "2024-03-01 00:00:00", None, None, "web"),
        ("d", "app_open", None, None, None, "web"),
    ]), REF)
    got = {r["customer_id"]: r["recency_days"] for r in out.collect()}
    assert got == {"a": 0, "b": 1, "c": 0, "d": 0}


def test_windows_include_the_cutoff_and_future_events(spark):
    out = fe.rfm(events(spark, [
        ("a", "purchase", "2024-01-16 00:00:00", 5.0, None, "web"),
        ("a", "purchase", "2024-01-15 23:59:59", 7.0, None, "web"),
        ("a", "purchase", "2024-06-01 00:00:00", 11.0, None, "web"),
        ("a", "purchase", "2023-11-16 23:59:59", 100.0, None, "web"),
        ("a", "purchase", "2024-02-01 00:00:00", None, None, "web"),
        ("a", "purchase", "2024-02-01 00:00:00", float("nan"), None, "web"),
        ("a", "redeem", "2024-02-01 00:00:00", 50.0, None, "web"),
    ]), REF).first()
    assert out["frequency_30d"] == 5
    assert out["monetary_90d"] == 23.0


def test_redemption_rate_without_views_is_zero_and_is_clipped(spark):
    rows = [("none", "redeem", "2024-02-01", None, "o", "web")]
    rows += [("more", t, "2024-02-01", None, "o", "web") for t in ("offer_view", "redeem", "redeem")]
    rows += [("half", t, "2020-02-01", None, "o", "web") for t in ("offer_view", "offer_view", "redeem")]
    out = fe.rfm(events(spark, rows), REF)
    assert one(out, "none")["offer_redemption_rate"] == 0.0
    assert one(out, "more")["offer_redemption_rate"] == 1.0
    assert one(out, "half")["offer_redemption_rate"] == 0.5


def test_channel_tie_takes_the_smallest_and_nulls_do_not_count(spark):
    rows = [("tie", "app_open", "2024-02-01", None, None, c) for c in ("web", "mobile", "mobile", "web", None, None, None)]
    rows += [("null", "app_open", "2024-02-01", None, None, None)]
    rows += [(None, "app_open", "2024-02-01", None, None, "web")]
    out = fe.rfm(events(spark, rows), REF)
    assert one(out, "tie")["channel_preference"] == "mobile"
    assert one(out, "null")["channel_preference"] is None
    assert out.count() == 2


def test_constant_columns_give_score_zero(spark):
    out = fe.compute_features(events(spark, [
        ("a", "app_open", "2024-02-01", None, None, "web"), ("b", "app_open", "2024-02-02", None, None, "web"),
    ]), REF)
    assert [r["engagement_score"] for r in out.collect()] == [0.0, 0.0]


def by_pandas(frame: pd.DataFrame, now: pd.Timestamp) -> pd.DataFrame:
    """The same features computed naively, one customer at a time."""
    rows = []
    for customer, g in frame.groupby("customer_id"):
        views, redeems = (g.event_type == "offer_view").sum(), (g.event_type == "redeem").sum()
        spend = g[(g.event_type == "purchase") & (g.timestamp >= now - pd.Timedelta(days=90))].amount.sum()
        rows.append({
            "customer_id": customer,
            "recency_days": max((now - g.timestamp.max()).days, 0),
            "frequency_30d": int((g.timestamp >= now - pd.Timedelta(days=30)).sum()),
            "monetary_90d": float(spend),
            "offer_redemption_rate": min(redeems / views, 1.0) if views else 0.0,
            "channel_preference": sorted(g.channel.mode())[0],
        })
    out = pd.DataFrame(rows)

    def mm(s):
        return (s - s.min()) / (s.max() - s.min())

    score = 0.3 * mm(out.frequency_30d) + 0.4 * mm(out.monetary_90d) + 0.3 * mm(out.offer_redemption_rate)
    out["engagement_score"] = score.clip(0, 1).round(6)
    return out


def test_generated_events_and_their_features(spark):
    frame = generate_events(spark.range(4000), REF, n_customers=200).drop("id").cache()
    assert {r[0] for r in frame.select("event_type").distinct().collect()} == set(EVENT_TYPES)
    assert {r[0] for r in frame.select("channel").distinct().collect()} == set(CHANNELS)
    assert frame.filter("(event_type = 'purchase') <> (amount is not null)").isEmpty()
    assert frame.filter("(event_type in ('offer_view','redeem')) <> (offer_id is not null)").isEmpty()
    got = fe.compute_features(frame, REF).toPandas().sort_values("customer_id", ignore_index=True)
    want = by_pandas(frame.toPandas(), pd.Timestamp(REF)).sort_values("customer_id", ignore_index=True)
    assert set(got.columns) == {f.name for f in schemas.FEATURES}
    for column in want.columns:
        if want[column].dtype.kind == "f":
            np.testing.assert_allclose(got[column], want[column], atol=1e-6)
        else:
            assert got[column].tolist() == want[column].tolist()
    assert got.engagement_score.between(0, 1).all()


def test_generator_does_not_depend_on_partitioning(spark):
    a = generate_events(spark.range(0, 500, 1, 1), REF).toPandas()
    b = generate_events(spark.range(0, 500, 1, 7), REF).toPandas().sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(a, b)


def test_events_are_scanned_once(spark, tmp_path):
    path = str(tmp_path / "events")
    generate_events(spark.range(200), REF).write.parquet(path)
    out = fe.compute_features(spark.read.parquet(path), REF)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_rounding_agrees_with_python(spark):
    from perkwise.functions.numbers import fixed_text, round_exact

    rng = np.random.default_rng(11)
    values = [2.675, 0.125, 1234.5, 1.005, -0.5, 0.0005, 2.5, -2.675, 0.0, 1e17, 12345678.125, 0.285, 1.115]
    values += (rng.integers(-10**6, 10**6, 400) / 2000).tolist() + rng.normal(0, 100, 200).tolist()
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    for digits in (0, 1, 2, 3, 4):
        rows = frame.select("v", fixed_text(F.col("v"), digits).alias("t"), round_exact(F.col("v"), digits).alias("r")).collect()
        for row in rows:
            assert row["r"] == round(row["v"], digits)
            assert row["t"] == format(row["v"], f".{digits}f")
