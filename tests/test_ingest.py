import pytest

from perkwise.operators import ingest

NOW = "2024-01-01 00:00:00"
RAW = "transaction_id string, customer_id string, amount string, currency string, store_id string, items string, created_at string, arrival int"


def test_defaults_and_whitespace(spark):
    raw = spark.createDataFrame([(None, " c ", " 12.5 ", None, "s ", None, None, 1), (None, "c", "12.5", None, "s", None, None, 2)], RAW)
    rows = ingest.check_transactions(raw, NOW).valid.orderBy("arrival").collect()
    assert (rows[0]["customer_id"], rows[0]["amount"], rows[0]["currency"], rows[0]["store_id"], rows[0]["items"]) == ("c", 12.5, "USD", "s", "[]")
    assert str(rows[0]["created_at"]) == NOW
    assert rows[0]["transaction_id"] != rows[1]["transaction_id"]


def test_reasons_and_strict_mode(spark):
    raw = spark.createDataFrame([("t", None, "x", None, None, None, "never", 1), ("u", "c", "1", None, "s", None, None, 2)], RAW)
    checked = ingest.check_transactions(raw, NOW)
    assert checked.quarantine.first()["reasons"] == ["customer_id", "amount", "store_id", "created_at"]
    assert checked.valid.count() == 1
    with pytest.raises(ingest.InvalidRecords):
        checked.strict()
    strict = ingest.check_transactions(raw.filter("transaction_id = 'u'"), NOW, require_uuid=True)
    assert strict.quarantine.first()["reasons"] == ["customer_id_format", "transaction_id_format"]


def test_customer_defaults(spark):
    raw = spark.createDataFrame([("1", " a@x ", None, None, None, None, None, 1), ("2", None, "gold", "x", "y", None, None, 2)],
        "customer_id string, email string, tier string, total_spend string, visit_count string, created_at string, updated_at string, arrival int")
    checked = ingest.check_customers(raw, NOW)
    good = checked.valid.first()
    assert (good["email"], good["tier"], good["total_spend"], good["visit_count"]) == ("a@x", "standard", 0.0, 0)
    assert checked.quarantine.first()["reasons"] == ["email", "total_spend", "visit_count"]


def test_unknown_feedback_event_is_quarantined(spark):
    raw = spark.createDataFrame([("c", "r", "click", None, None), ("c", "r", "view", "{}", None), ("c", "r", None, "{}", None)],
        "customer_id string, request_id string, event_type string, metadata string, created_at timestamp")
    checked = ingest.check_feedback_events(raw, NOW)
    assert checked.valid.first()["metadata"] == "{}"
    assert checked.quarantine.count() == 2


def test_ratings(spark):
    raw = spark.createDataFrame([(1, "o", "c", "x", r, t, None, None, None) for r, t in ((1, "up"), (5, "down"), (0, "up"), (6, "up"), (3, "side"))],
        "id int, offer_id string, customer_id string, generated_copy string, rating int, thumbs string, prompt_version string, model_version string, created_at timestamp")
    checked = ingest.check_ratings(raw, NOW)
    assert checked.valid.count() == 2 and checked.valid.first()["prompt_version"] == ""


def test_bad_records_are_set_aside_and_never_stop_a_load(spark):
    from pyspark.sql import functions as F

    from perkwise.operators import ingest

    ratings = spark.createDataFrame(
        [("1", "o", "c", "{}", "5", "up", None), ("2", "o", "c", "{}", "abc", "up", None), ("3", "o", "c", "{}", "4.7", "down", None),
         ("4", "o", "c", "{}", "4", "up", "not a date")],
        "id string, offer_id string, customer_id string, generated_copy string, rating string, thumbs string, created_at string",
    ).withColumn("prompt_version", F.lit(None).cast("string")).withColumn("model_version", F.lit(None).cast("string"))
    checked = ingest.check_ratings(ratings, "2024-02-15 00:00:00")
    assert [r.id for r in checked.valid.collect()] == ["1"]
    assert sorted((r.id, tuple(r.reasons)) for r in checked.quarantine.collect()) == [("2", ("rating",)), ("3", ("rating",)), ("4", ("created_at",))]
    customers = spark.createDataFrame(
        [("\tk\n", " a@b ", None, "1.5", "\t7\n", "2024-01-01", None, 1), ("l", "c@d", None, None, None, "soon", "later", 2)],
        "customer_id string, email string, tier string, total_spend string, visit_count string, created_at string, updated_at string, arrival long")
    checked = ingest.check_customers(customers, "2024-02-15 00:00:00")
    (good,), (bad,) = checked.valid.collect(), checked.quarantine.collect()
    assert (good.customer_id, good.email, good.visit_count) == ("k", "a@b", 7)
    assert bad.reasons == ["created_at", "updated_at"]


def test_a_shared_folder_is_required_off_a_local_master():
    import pytest as pytest_

    from perkwise import session

    class Unset:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest_.raises(ValueError):
        session.shared_folder(Unset)
