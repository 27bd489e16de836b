"""Propensity model queries."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks import query, sql
from perkwise.operators import propensity as mo
from perkwise.operators.features import compute_features
from perkwise.plans import training
from perkwise.schemas import FEATURE_COLUMNS
from perkwise.sources import sample_tables as st

_CODE = "CASE channel WHEN 'in-store' THEN 0.0 WHEN 'mobile' THEN 1.0 ELSE 2.0 END::DOUBLE"


def _features(spark, d):
    return compute_features(st.loyalty_events(spark, d), st.REFERENCE_TS)


@query("mod1_channel_code", f"""SELECT event_id, CASE CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN 'fax' WHEN k % 3 = 0 THEN 'mobile'
  WHEN k % 3 = 1 THEN 'web' ELSE 'in-store' END WHEN 'in-store' THEN 0.0 WHEN 'mobile' THEN 1.0 ELSE 2.0 END::DOUBLE AS code
  FROM {sql.EV}""")
def channel_code(spark, d):
    k = F.col("k")
    channel = (
        F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, "fax").when(k % 3 == 0, "Mobile")
        .when(k % 3 == 1, "WEB").otherwise("in-store")
    )
    return st.raw_events(spark, d).select("event_id", mo.channel_code(channel).alias("code"))


@query("mod2_channel_code_strict", f"SELECT customer_id, ts AS timestamp, {_CODE} AS code FROM {sql.LOYALTY}")
def channel_code_strict(spark, d):
    return st.loyalty_events(spark, d).select(
        "customer_id", "timestamp", mo.channel_code(F.col("channel"), strict=True).alias("code")
    )


@query("mod3_label", f"SELECT customer_id, CAST(offer_redemption_rate > 0.3 AS INT) AS label FROM {sql.features()}")
def label(spark, d):
    return _features(spark, d).select("customer_id", mo.label(F.col("offer_redemption_rate")).alias("label"))


@query("mod4_feature_matrix", " UNION ALL ".join(
    f"""SELECT customer_id, {i} AS position, round(CAST({c if c != 'channel_preference' else _CODE.replace('channel', 'channel_preference', 1)}
    AS FLOAT)::DOUBLE, 2) AS value FROM {sql.features()}""" for i, c in enumerate(FEATURE_COLUMNS)))
def feature_matrix(spark, d):
    rows = mo.feature_matrix(_features(spark, d))
    return rows.select("customer_id", F.posexplode(vector_to_array("features")).alias("position", "value")).withColumn(
        "value", F.round("value", 2)
    )


@query("mod5_stratified_split", f"""SELECT customer_id, label, CASE WHEN r <= floor(n * 0.15::DOUBLE + 0.5::DOUBLE) THEN 'test'
    WHEN r <= 2 * floor(n * 0.15::DOUBLE + 0.5::DOUBLE) THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT CAST(event_id AS VARCHAR) AS customer_id, CAST(event_type = 'purchase' AS INT) AS label,
    row_number() OVER (PARTITION BY event_type = 'purchase' ORDER BY md5('42:split:' || event_id), CAST(event_id AS VARCHAR)) AS r,
    count(*) OVER (PARTITION BY event_type = 'purchase') AS n FROM events)""")
def stratified_split(spark, d):
    rows = st.raw_events(spark, d).select(
        F.col("event_id").cast("string").alias("customer_id"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
    )
    return mo.stratified_split(rows)


@query("mod6_logistic_scores")
def logistic_scores(spark, d):
    stored = st.stored_features(spark, d)
    return mo.score(training.train_light(stored), _features(spark, d))


@query("mod7_epoch_metrics")
def epoch_metrics(spark, d):
    trained = training.train(st.stored_features(spark, d), epochs=6)
    return trained.metrics.withColumn("best_epoch", F.lit(trained.best_epoch))


@query("mod8_batch_scores")
def batch_scores(spark, d):
    return training.train(st.stored_features(spark, d), epochs=6).score(_features(spark, d))


@query("mod8_results", f"""SELECT CAST(doc_id AS VARCHAR) AS customer_id, score AS propensity_score, CAST(score >= 0.5 AS INT) AS label,
  0.5::DOUBLE AS threshold, '1' AS model_version FROM {sql.SCORED}""")
def results(spark, d):
    rows = st.scored_labels(spark, d).withColumn("customer_id", F.col("doc_id"))
    return mo.as_results(rows, 0.5, "1", "score")


AUC = f"""(SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*) AS roc_auc
  FROM {sql.SCORED} p, {sql.SCORED} n WHERE p.label = 1 AND n.label = 0)"""


@query("mod9_roc_auc", f"SELECT round(roc_auc, 9) AS roc_auc FROM {AUC}")
def roc_auc(spark, d):
    return mo.ranking_metrics(st.scored_labels(spark, d)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("mod10_average_precision", f"""SELECT round(sum(pos * tp / shown) / max(tp), 9) AS avg_precision FROM (
  SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS shown
  FROM (SELECT score, sum(label) AS pos, count(*) AS n FROM {sql.SCORED} GROUP BY score))""")
def average_precision(spark, d):
    return mo.ranking_metrics(st.scored_labels(spark, d)).select(F.round("avg_precision", 9).alias("avg_precision"))


@query("mod11_precision_recall", f"""SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) / count(*) FILTER (WHERE score >= 0.5) AS precision,
  count(*) FILTER (WHERE score >= 0.5 AND label = 1) / count(*) FILTER (WHERE label = 1) AS recall FROM {sql.SCORED}""")
def precision_recall(spark, d):
    return mo.threshold_metrics(st.scored_labels(spark, d)).select("precision", "recall")


@query("mod12_mean_score", f"SELECT round(avg(score), 9) AS mean_score FROM {sql.SCORED}")
def mean_score(spark, d):
    return mo.threshold_metrics(st.scored_labels(spark, d)).select(F.round("mean_score", 9).alias("mean_score"))


@query("mod13_cross_entropy", f"""SELECT round(avg(-(label * CASE WHEN score > 0 THEN greatest(ln(score), -100) ELSE -100 END
  + (1 - label) * CASE WHEN score < 1 THEN greatest(ln(1 - score), -100) ELSE -100 END)), 6) AS loss FROM {sql.SCORED}""")
def cross_entropy(spark, d):
    return mo.threshold_metrics(st.scored_labels(spark, d)).select(F.round("loss", 6).alias("loss"))


@query("mod14_auc_gate", f"""SELECT round(roc_auc, 9) AS roc_auc, 0.75::DOUBLE AS threshold, roc_auc >= 0.75 AS passed FROM {AUC}""")
def auc_gate(spark, d):
    return mo.auc_gate(mo.ranking_metrics(st.scored_labels(spark, d))).withColumn("roc_auc", F.round("roc_auc", 9))


@query("mod15_metrics_log")
def metrics_log(spark, d):
    return training.metrics_log(training.train(st.stored_features(spark, d), epochs=6))
