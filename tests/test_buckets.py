import pytest
from pyspark.sql import functions as F

from perkwise.operators.buckets import BucketedTable
from perkwise.operators.ingest import insert_transactions, upsert_customers  # noqa: F401
from perkwise.operators.keyed import insert_ignore, upsert
from perkwise.session import folders

KIND = "k string, v int, first string"


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", i, "old") for i in range(200)], KIND)
    out = BucketedTable(spark, str(tmp_path / "t"), ("k",), rows.schema, 16)
    assert out.read().count() == 0 and out.read().schema == rows.schema
    out.upsert(rows, ["v"])
    return out


def content(frame):
    return sorted(map(tuple, frame.collect()))


def batch(spark, keys, value=1000):
    return spark.createDataFrame([(k, value + i, "new", i) for i, k in enumerate(keys)], f"{KIND}, arrival int")


def test_merge_equals_that_of_snapshots(spark, table):
    new = batch(spark, ["k3", "k3", "x1", "k150", "x1"])
    want = content(upsert(table.read(), new, ["k"], ["arrival"], ["first"]))
    assert table.upsert(new, ["arrival"], ["first"], "b1")
    assert content(table.read()) == want
    more = batch(spark, ["k3", "y1", "y1"], 5000)
    want = content(insert_ignore(table.read(), more, ["k"], ["arrival"]))
    assert table.insert_ignore(more, ["arrival"], "b2")
    assert content(table.read()) == want
    # Known batches change nothing.
    assert not table.upsert(batch(spark, ["k3"], 9), ["arrival"], name="b1") and not table.insert_ignore(batch(spark, ["z"]), ["arrival"], "b2")
    assert content(table.read()) == want
    table.compact()
    assert content(table.read()) == want and table.current().count() == 16
    assert table.vacuum() > 0 and content(table.read()) == want
    assert len(folders(spark, f"{table.path}/rows")) == 16


def test_other_buckets_are_neither_read_nor_written(spark, table):
    new = batch(spark, ["k3"])
    touched = table.touched(new)
    assert len(touched) == 1
    before = {r["bucket"]: r["slot"] for r in table.current().collect()}
    files = table.read(touched).inputFiles()
    plan = table.read(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "slot" in plan.split("PartitionFilters")[1]
    scanned = table.read(touched).select(F.input_file_name()).distinct().collect()
    assert len(scanned) == 1 and before[touched[0]] in scanned[0][0] and len(files) >= 1
    table.upsert(new, ["arrival"])
    after = {r["bucket"]: r["slot"] for r in table.current().collect()}
    assert {b for b in after if after[b] != before[b]} == set(touched)


def test_crash_before_publishing_leaves_the_old_state(spark, table, monkeypatch):
    want = content(table.read())

    def crash(*args):
        raise RuntimeError("lost")

    for merge in (table.upsert, table.insert_ignore):
        with monkeypatch.context() as m:
            m.setattr(BucketedTable, "publish", crash)
            with pytest.raises(RuntimeError):
                merge(batch(spark, ["k3", "new"]), ["arrival"], name="b")
        assert content(table.read()) == want
    # A smaller batch takes the same commit number; what the crash left in other buckets stays unseen.
    assert table.upsert(batch(spark, ["new"]), ["arrival"], name="b")
    assert content(table.read()) == sorted([*want, ("new", 1000, "new")])


def test_empty_batch_and_null_keys(spark, table):
    want = content(table.read())
    assert table.upsert(batch(spark, []).limit(0), ["arrival"], name="none")
    assert content(table.read()) == want and not table.upsert(batch(spark, ["q"]), ["arrival"], name="none")
    assert table.insert_ignore(spark.createDataFrame([(None, 1, "n", 0)], f"{KIND}, arrival int"), ["arrival"])
    assert table.read().filter("k is null").count() == 1
