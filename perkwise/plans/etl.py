"""Ingest transactions and load customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perkwise.operators.ingest import check_customers, check_transactions, new_transactions, upsert_customers


def run(
    transactions: DataFrame, raw_transactions: DataFrame, customers: DataFrame,
    raw_customers: DataFrame, received_at: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New snapshots of both tables and a two-row summary of the rows written.

    The snapshots are returned unwritten: store them at a fresh path, never at the one being read.
    """
    good_transactions = check_transactions(raw_transactions, received_at).valid
    good_customers = check_customers(raw_customers, received_at).valid
    added = new_transactions(transactions, good_transactions)
    counts = added.agg(F.count(F.lit(1)).alias("written")).select(
        F.lit("transactions").alias("table_name"), "written"
    ).unionByName(
        # Every valid record inserts or updates a row.
        good_customers.agg(F.count(F.lit(1)).alias("written")).select(
            F.lit("customers").alias("table_name"), "written"
        )
    )
    return transactions.unionByName(added), upsert_customers(customers, good_customers), counts
