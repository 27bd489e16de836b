"""Validation of incoming records and the upserts they feed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from perkwise.functions.draws import uuid_text
from perkwise.functions.text import strip
from perkwise.operators.keyed import insert_ignore, new_rows, upsert

# Allowed codes.
FEEDBACK_EVENT_TYPES = ["click", "redeem", "ignore", "unsubscribe"]
THUMBS = ["up", "down"]

_UUID = r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


class InvalidRecords(ValueError):
    """Raised in strict mode when a batch holds a bad record."""


@dataclass(frozen=True)
class Checked:
    """A batch with its ``reasons`` per row."""

    rows: DataFrame

    @property
    def valid(self) -> DataFrame:
        return self.rows.filter(F.size("reasons") == 0).drop("reasons")

    @property
    def quarantine(self) -> DataFrame:
        return self.rows.filter(F.size("reasons") > 0)

    def strict(self) -> DataFrame:
        """The whole batch, or an error when any record is bad."""
        bad = self.quarantine.select("reasons").head(1)
        if bad:
            raise InvalidRecords(f"batch holds invalid records, e.g. {bad[0]['reasons']}")
        return self.valid


def _reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    return F.array_compact(F.array(*failed)).alias("reasons")


def _text(column: str) -> Column:
    """The value as text without white space at its ends."""
    return strip(F.col(column).cast("string"))


def _time(column: str) -> Column:
    """The value as a time, null where it is none."""
    return _text(column).try_cast("timestamp")


def _valid_time(column: str) -> tuple[str, Column]:
    return column, F.col(column).isNull() | _time(column).isNotNull()


def check_transactions(
    raw: DataFrame, received_at: str, arrival: str = "arrival", require_uuid: bool = False
) -> Checked:
    """Coerce and validate raw transactions.

    customer_id, amount and store_id are required. A missing transaction_id is derived from the
    record and its arrival number, so a recomputed task yields the same id.
    """
    amount = _text("amount").try_cast("double")
    generated = uuid_text(
        F.md5(F.concat_ws("|", F.col(arrival).cast("string"), _text("customer_id"), _text("store_id")))
    )
    created = _time("created_at")
    rules = [
        ("customer_id", F.col("customer_id").isNotNull()),
        ("amount", amount.isNotNull()),
        ("store_id", F.col("store_id").isNotNull()),
        _valid_time("created_at"),
    ]
    if require_uuid:
        rules.append(("customer_id_format", _text("customer_id").rlike(_UUID)))
        rules.append((
            "transaction_id_format",
            F.col("transaction_id").isNull() | _text("transaction_id").rlike(_UUID),
        ))
    return Checked(
        raw.select(
            F.coalesce(_text("transaction_id"), generated).alias("transaction_id"),
            _text("customer_id").alias("customer_id"),
            amount.alias("amount"),
            F.coalesce(_text("currency"), F.lit("USD")).alias("currency"),
            _text("store_id").alias("store_id"),
            F.coalesce(F.col("items"), F.lit("[]")).alias("items"),
            F.coalesce(created, F.lit(received_at).cast("timestamp")).alias("created_at"),
            F.col(arrival).alias("arrival"),
            _reasons(rules),
        )
    )


def check_customers(raw: DataFrame, received_at: str, arrival: str = "arrival") -> Checked:
    """Coerce and validate customer profiles; email is required, the rest has defaults."""
    spend = _text("total_spend").try_cast("double")
    visits = _text("visit_count").try_cast("int")
    stamp = F.lit(received_at).cast("timestamp")
    generated = uuid_text(F.md5(F.concat_ws("|", F.col(arrival).cast("string"), _text("email"))))
    return Checked(
        raw.select(
            F.coalesce(_text("customer_id"), generated).alias("customer_id"),
            _text("email").alias("email"),
            F.coalesce(_text("tier"), F.lit("standard")).alias("tier"),
            F.coalesce(spend, F.lit(0.0)).alias("total_spend"),
            F.coalesce(visits, F.lit(0)).alias("visit_count"),
            F.coalesce(_time("created_at"), stamp).alias("created_at"),
            F.coalesce(_time("updated_at"), stamp).alias("updated_at"),
            F.col(arrival).alias("arrival"),
            _reasons([
                ("email", F.col("email").isNotNull()),
                ("total_spend", F.col("total_spend").isNull() | spend.isNotNull()),
                ("visit_count", F.col("visit_count").isNull() | visits.isNotNull()),
                _valid_time("created_at"),
                _valid_time("updated_at"),
            ]),
        )
    )


def check_feedback_events(raw: DataFrame, received_at: str) -> Checked:
    """Feedback events with a known type; ids become text, metadata defaults to an empty object."""
    return Checked(
        raw.select(
            F.col("customer_id").cast("string").alias("customer_id"),
            F.col("request_id").cast("string").alias("request_id"),
            "event_type",
            F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"),
            F.coalesce(_time("created_at"), F.lit(received_at).cast("timestamp")).alias(
                "created_at"
            ),
            _reasons([
                ("customer_id", F.col("customer_id").isNotNull()),
                ("request_id", F.col("request_id").isNotNull()),
                ("event_type", F.col("event_type").isin(FEEDBACK_EVENT_TYPES)),
                _valid_time("created_at"),
            ]),
        )
    )


def check_ratings(raw: DataFrame, received_at: str) -> Checked:
    """Whole ratings 1..5 with a thumb up or down; version columns default to the empty string."""
    number = _text("rating").try_cast("double")
    rating = F.when(number == F.floor(number), number).try_cast("int")
    required = ["offer_id", "customer_id", "generated_copy"]
    return Checked(
        raw.select(
            "id", *required, rating.alias("rating"), "thumbs",
            F.coalesce("prompt_version", F.lit("")).alias("prompt_version"),
            F.coalesce("model_version", F.lit("")).alias("model_version"),
            F.coalesce(_time("created_at"), F.lit(received_at).cast("timestamp")).alias(
                "created_at"
            ),
            _reasons([
                *[(c, F.col(c).isNotNull()) for c in required],
                ("rating", rating.between(1, 5)),
                ("thumbs", F.col("thumbs").isin(THUMBS)),
                _valid_time("created_at"),
            ]),
        )
    )


def new_transactions(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Transactions of a checked batch that are not known yet; the first of a repeated id wins."""
    return new_rows(existing, batch, ["transaction_id"], ["arrival"]).select(*existing.columns)


def insert_transactions(existing: DataFrame, batch: DataFrame) -> DataFrame:
    return insert_ignore(existing, batch, ["transaction_id"], ["arrival"])


def upsert_customers(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Profiles overwritten by the last record of the batch; the first created_at is kept."""
    return upsert(existing, batch, ["customer_id"], ["arrival"], preserve=["created_at"])


def insert_calls(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Model-call log without repeated request ids; the earliest wins, of equal times the smallest values."""
    rest = [c for c in existing.columns if c not in ("request_id", "created_at")]
    return insert_ignore(existing, batch, ["request_id"], ["created_at", *rest])


def encode_items(items: Column) -> Column:
    """Line items as a JSON array, ``[]`` when there are none."""
    return F.coalesce(F.to_json(items), F.lit("[]"))


def decode_items(text: Column, item_type: str) -> Column:
    return F.from_json(text, f"array<{item_type}>")
