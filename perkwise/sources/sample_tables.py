"""The shared sample tables seen through the domain schemas (rules in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from perkwise.operators.features import compute_features
from perkwise.operators.buckets import BucketedTable
from perkwise.operators.store import read_store, write_version
from perkwise.session import scratch_path

REFERENCE_TS = "2024-02-15 00:00:00"
# The same events seen at three moments give three versions of the feature store.
VERSION_TIMES = {
    "v1": "2024-02-01 00:00:00",
    "v2": "2024-02-08 00:00:00",
    "v3": "2024-02-15 00:00:00",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _by_k(*names: str) -> Column:
    picked = F.when(F.col("k") % len(names) == 0, F.lit(names[0]))
    for i, name in enumerate(names[1:], start=1):
        picked = picked.when(F.col("k") % len(names) == i, F.lit(name))
    return picked


def loyalty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return raw_events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("customer_id"),
        F.when(kind == "purchase", "purchase").when(kind == "view", "offer_view")
        .when(kind == "click", "redeem").otherwise("app_open").alias("event_type"),
        F.col("ts").alias("timestamp"),
        F.when(kind == "purchase", F.col("value")).alias("amount"),
        F.when(kind.isin("view", "click"), F.col("k").cast("string")).alias("offer_id"),
        _by_k("mobile", "web", "in-store").alias("channel"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of each order as an array of structs."""
    item = F.struct(
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
    )
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").cast("string").alias("transaction_id")
    ).agg(F.array_sort(F.collect_list(item)).alias("items"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_totalprice").alias("amount"),
        F.lit("USD").alias("currency"),
        F.concat(F.lit("store-"), (F.col("o_custkey") % 10).cast("string")).alias("store_id"),
        F.lit("[]").alias("items"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as untyped payloads: padded text, missing fields, amounts that are not numbers."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(key % 17 != 0, F.concat(F.lit(" "), key.cast("string"), F.lit(" "))).alias("transaction_id"),
        F.when(key % 19 != 0, F.col("o_custkey").cast("string")).alias("customer_id"),
        F.when(key % 13 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("amount"),
        F.when(F.col("o_orderstatus") == "F", F.lit("EUR ")).alias("currency"),
        F.when(key % 11 != 0, F.concat(F.lit("store-"), (F.col("o_custkey") % 10).cast("string"))).alias("store_id"),
        F.lit(None).cast("string").alias("items"),
        F.col("o_orderdate").cast("string").alias("created_at"),
        key.alias("arrival"),
    )


def transaction_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).filter("created_at < timestamp'1999-01-01'")


def transaction_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later delivery overlapping the snapshot, in which every order arrives twice."""
    late = transactions(spark, sf_dir).filter("created_at >= timestamp'1998-01-01'")
    twice = late.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival"))
    return twice.withColumn("amount", F.col("amount") + F.col("arrival").cast("double"))


def customer_profiles(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Customers having orders in the given frame, with totals over it."""
    activity = orders.groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("total_spend"),
        F.count(F.lit(1)).cast("int").alias("visit_count"),
        F.min("o_orderdate").cast("timestamp").alias("created_at"),
        F.max("o_orderdate").cast("timestamp").alias("updated_at"),
    )
    customers = table(spark, sf_dir, "customer")
    return customers.join(activity, customers.c_custkey == activity.o_custkey).select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.col("c_mktsegment").alias("tier"),
        F.round("total_spend", 2).alias("total_spend"),
        "visit_count", "created_at", "updated_at",
    )


# Every order is in the snapshot, in the batch or in both; of the customers a third is in both.
SNAPSHOT_ORDERS = "o_custkey % 3 = 0 OR (o_custkey % 3 = 1 AND o_orderkey % 3 <> 2)"
BATCH_ORDERS = "o_custkey % 3 = 2 OR (o_custkey % 3 = 1 AND o_orderkey % 3 <> 0)"


def customer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_profiles(spark, sf_dir, table(spark, sf_dir, "orders").filter(SNAPSHOT_ORDERS))


def customer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New profiles, each arriving twice; the second time with one more visit."""
    recent = table(spark, sf_dir, "orders").filter(BATCH_ORDERS)
    twice = customer_profiles(spark, sf_dir, recent).select(
        "*", F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival")
    )
    return twice.withColumn("visit_count", (F.col("visit_count") + F.col("arrival") - 1).cast("int"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings; copy of events with k divisible by 10 is plain text instead of JSON."""
    copy = F.to_json(F.struct(
        F.concat(F.lit("Deal "), F.col("k").cast("string")).alias("headline"),
        F.concat(F.lit("Body of "), F.col("event_id").cast("string")).alias("body"),
        F.lit("Redeem").alias("cta"),
    ))
    return raw_events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        (F.col("k") * 10 + F.col("user_id") % 10).cast("string").alias("offer_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.when(F.col("k") % 10 == 0, F.concat(F.lit("plain copy "), F.col("event_id").cast("string")))
        .otherwise(copy).alias("generated_copy"),
        (F.lit(1) + F.col("event_id") * 7 % 5).cast("int").alias("rating"),
        F.when(F.col("event_type") == "error", "down").otherwise("up").alias("thumbs"),
        F.element_at(F.array(F.lit(""), F.lit("v1"), F.lit("v2")), (F.col("event_id") % 3 + 1).cast("int"))
        .alias("prompt_version"),
        F.element_at(F.array(F.lit("m0"), F.lit("m1")), (F.col("event_id") % 2 + 1).cast("int"))
        .alias("model_version"),
        F.col("ts").alias("created_at"),
    )


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return raw_events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("event_id").cast("string").alias("request_id"),
        F.when(kind == "purchase", "redeem").when(kind == "error", "ignore")
        .when(kind == "signup", "unsubscribe").otherwise(kind).alias("event_type"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit("}")))
        .alias("metadata"),
        F.col("ts").alias("created_at"),
    )


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("request_id"),
        F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("model"),
        F.col("k").alias("prompt_tokens"),
        (F.col("k") * 2).cast("int").alias("completion_tokens"),
        (F.col("value") * 10.0).alias("latency_ms"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") / 500.0).alias("score"),
        F.col("ts").alias("created_at"),
    )


def drift_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with a window tag; some exceed 1."""
    return raw_events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        (F.col("value") / 200.0).alias("score"),
        (F.col("k") / 100.0).alias("frequency_share"),
        F.col("ts").alias("scored_at"),
        F.when(F.col("ts") < F.lit("2024-01-23").cast("timestamp"), "baseline").otherwise("current")
        .alias("period"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is an offer."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("offer_"), F.lpad(vec.cast("string"), 7, "0")).alias("id"),
        F.concat(F.lit("Offer "), vec.cast("string")).alias("title"),
        F.concat(F.lit("Reward number "), vec.cast("string"), F.lit(" of group "), F.col("label").cast("string"))
        .alias("description"),
        F.col("label").cast("string").alias("category"),
        F.lit("all").alias("channel"),
        (vec * 37 % 71 / 100.0).alias("min_propensity_threshold"),
        (vec % 36 + 5).cast("int").alias("discount_pct"),
        F.lit(30).alias("expiry_days"),
        "embedding",
    )


def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is also a query; an offer of the same label counts as relevant."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        vec.cast("string").alias("query_id"),
        "embedding",
        F.col("label").cast("string").alias("expected_category"),
        (vec * 53 % 101 / 100.0).alias("propensity"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
        .select(
            "doc_id", F.col("quality").alias("label"),
            F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("score"),
        )
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content")
    )


def copy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant text against the text of the turn before it."""
    turns = table(spark, sf_dir, "conversations")
    earlier = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return (
        turns.filter("role = 'assistant'").join(earlier, ["conv_id", "turn"])
        .select(
            F.concat_ws("-", "conv_id", "turn").alias("pair_id"),
            F.col("text").alias("generated"), "reference",
        )
    )


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose around a JSON object; some without JSON, some lacking a key."""
    doc = F.col("doc_id")
    safe = F.regexp_replace("text", r"[{}]", " ")
    good = F.to_json(F.struct(
        F.concat(F.lit("Headline "), doc.cast("string")).alias("headline"),
        F.col("source").alias("body"), F.lit("Redeem now").alias("cta"),
        F.lit("friendly").alias("tone"), F.col("lang").alias("subject"),
        F.concat(F.lit("CODE"), doc.cast("string")).alias("offer_code"),
    ))
    lacking = F.to_json(F.struct(F.col("source").alias("body"), F.lit("friendly").alias("tone")))
    raw = (
        F.when(doc % 5 == 0, safe)
        .when(doc % 7 == 0, F.concat(safe, F.lit("\n"), lacking, F.lit(" done")))
        .otherwise(F.concat(safe, F.lit("\n"), good, F.lit(" done")))
    )
    return table(spark, sf_dir, "documents").select(doc.alias("request_id"), raw.alias("raw"))


def response_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of one source are attempts at the same request, in order of document."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), F.concat_ws("/", "source", "lang").alias("request")
    )
    return raw_responses(spark, sf_dir).join(docs, "request_id").select(
        "request", F.col("request_id").alias("attempt"), "raw"
    )


def activation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up events as prompt activations, one prompt per user."""
    log = raw_events(spark, sf_dir).filter("event_type = 'signup'").select(
        F.concat(F.lit("prompt_"), F.col("user_id").cast("string")).alias("name"),
        F.concat(F.lit("v"), (F.col("k") % 5).cast("string")).alias("version"),
        F.col("ts").alias("activated_at"), F.col("event_id").alias("entry"),
    )
    earlier = Window.partitionBy("name").orderBy("activated_at", "entry")
    return log.withColumn("previous", F.lag("version").over(earlier))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as registered prompt texts; later ones replace earlier ones."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("name"), F.col("source").alias("version"),
        F.col("text").alias("template"), F.col("doc_id").alias("entry"),
    )


def bucketed(rows: DataFrame, keys: list[str], buckets: int = 8) -> BucketedTable:
    """The rows as a table in hash buckets."""
    spark = rows.sparkSession
    table_ = BucketedTable(spark, scratch_path(spark, "bucketed"), tuple(keys), rows.schema, buckets)
    table_.upsert(rows, keys)
    return table_


def feature_store(spark: SparkSession, sf_dir: str) -> str:
    """The path of a store with three versions of the features."""
    path = scratch_path(spark, "store")
    for version, moment in VERSION_TIMES.items():
        write_version(compute_features(loyalty_events(spark, sf_dir), moment), path, version, moment)
    return path


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of the features, written to and read back from a store."""
    return read_store(spark, feature_store(spark, sf_dir))
