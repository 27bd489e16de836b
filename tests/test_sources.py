import gzip
import json
from datetime import datetime
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import checks
from perkwise import schemas
from perkwise.session import small_batches
from perkwise.sources import generators as gen, tables


def test_catalogue_in_one_pretty_file(spark, tmp_path):
    offers = [{"id": "offer_0001", "title": "T", "description": "D", "category": "food", "channel": "all",
               "min_propensity_threshold": 0.25, "discount_pct": 5, "expiry_days": 7}, {"id": "offer_0002"}]
    (tmp_path / "offers.json").write_text(json.dumps(offers, indent=2))
    got = tables.read_catalogue(spark, str(tmp_path / "offers.json")).orderBy("id").collect()
    assert got[0].asDict() == offers[0] and got[1]["title"] is None


def test_catalogue_round_trip(spark, tmp_path):
    offers = gen.generate_offers(spark.range(200), ["A", "B"], ["C"])
    path = str(tmp_path / "offers")
    tables.write_catalogue(offers, path, rows_per_file=40)
    back = tables.read_catalogue(spark, path)
    assert back.exceptAll(offers).isEmpty() and offers.exceptAll(back).isEmpty()
    assert len(list(Path(path).rglob("*.txt"))) == 5
    limits = offers.agg(F.min("discount_pct"), F.max("discount_pct"), F.max("min_propensity_threshold")).first()
    assert limits[0] >= 5 and limits[1] <= 40 and limits[2] <= 0.7


def test_features_are_not_overwritten(spark, tmp_path):
    frame = spark.createDataFrame([("c", 1, 2, 3.0, 0.5, "web", 0.5)], schemas.FEATURES)
    tables.write_features(frame, str(tmp_path / "f"))
    with pytest.raises(Exception, match="exists"):
        tables.write_features(frame, str(tmp_path / "f"))


def test_embedding_lines(spark, tmp_path):
    tables.export_embeddings(spark.createDataFrame([(7, [0.5, 1.0])], "id int, embedding array<float>").coalesce(1), str(tmp_path / "e"))
    (part,) = (tmp_path / "e").glob("part-*.json")
    assert json.loads(part.read_text()) == {"id": "7", "embedding": [0.5, 1.0]}


def test_pairs_are_written_as_packed_lines(spark, tmp_path):
    kinds, start = ("error", "click", "view"), datetime(2024, 1, 1)
    events = [(i, start, i % 40, kinds[i % 3], 1.0, json.dumps({"k": 1 + i % 2})) for i in range(600)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    checks.load()
    pairs = checks.QUERIES["src6_pairs_json_lines"](spark, str(tmp_path))
    texts = checks.QUERIES["fbk7_pair_texts"](spark, str(tmp_path))
    assert pairs.exceptAll(texts).isEmpty() and texts.exceptAll(pairs).isEmpty() and pairs.count() > 5000
    files = [Path(f.removeprefix("file://")) for f in pairs.inputFiles()]
    lines = [json.loads(x) for f in files for x in gzip.decompress(f.read_bytes()).splitlines()]
    assert sorted((x["prompt"], x["chosen"], x["rejected"]) for x in lines) == sorted(map(tuple, pairs.collect()))
    assert sum(f.stat().st_size for f in files) < sum(len(json.dumps(x)) for x in lines) / 15


def test_packed_lines_keep_nulls_and_are_cut_into_files(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(tables._PACKED, "maxRecordsPerFile", 4)
    frame = spark.createDataFrame([(i, None if i % 3 else "é\n") for i in range(10)], "a int, b string").coalesce(1)
    tables.write_json_lines(frame, str(tmp_path / "l"), packed=True)
    files = sorted((tmp_path / "l").glob("part-*.json.gz"))
    found = [[json.loads(x) for x in gzip.decompress(f.read_bytes()).splitlines()] for f in files]
    assert sorted(map(len, found)) == [2, 4, 4]
    assert sorted((x["a"], x["b"]) for f in found for x in f) == sorted(map(tuple, frame.collect()))


def test_scores_stay_in_range(spark):
    got = gen.generate_scores(spark.range(2000), 0.55, 0.18).agg(F.min("score"), F.max("score"), F.avg("score"), F.stddev("score")).first()
    assert got[0] >= 0.0 and got[1] <= 1.0 and got[2] == pytest.approx(0.55, abs=0.02) and got[3] == pytest.approx(0.18, abs=0.02)


def test_small_batches_bound_rows_and_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = spark.range(60, numPartitions=1).withColumn("text", F.repeat(F.lit("x"), 1000))
    settings = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(key) for key in settings]
    for bounds, most in (({"rows": 7}, 7), ({"rows": 50, "size": 10_000}, 11)):
        with small_batches(spark, **bounds):
            got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 60 and max(got) <= most
    assert [spark.conf.get(key) for key in settings] == before
