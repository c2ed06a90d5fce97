"""Readers, writers, saved fits and input checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wayfare.operators import output
from wayfare.sources import adapters, readers, writers


def test_required_columns(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="event_name"):
        readers.require_columns(df, ["event_name"])
    nested = spark.createDataFrame([([(1,)],)], "journey array<struct<ed_id:long>>")
    with pytest.raises(ValueError, match="event_timestamp"):
        readers.require_struct_fields(nested, "journey")
    assert readers.require_struct_fields(nested, "journey", ["ed_id"]) is nested


def test_unknown_states_are_refused(spark):
    known = spark.createDataFrame([(2, "a"), (4, "b")], "event_definition_id long, event_name string")
    assert readers.customer_states(known, [2, 4], include_success=True) == [2, 4, 28]
    with pytest.raises(ValueError, match="5"):
        readers.customer_states(known, [2, 5])


def test_definitions_from_csv(spark, tmp_path):
    known = spark.createDataFrame([(28, "order_shipped"), (4, "browse")], "event_definition_id long, event_name string")
    writers.write_csv(known, str(tmp_path / "d"))
    assert sorted(readers.read_definitions(spark, str(tmp_path / "d")).collect()) == sorted(known.collect())


def test_csv_and_parquet(spark, small, tmp_path):
    events = adapters.raw_events(spark, small).limit(50)
    writers.write_parquet(events, str(tmp_path / "p"))
    back = readers.read_events(spark, str(tmp_path / "p"))
    assert sorted(back.collect()) == sorted(events.collect())
    sample = readers.read_events(spark, str(tmp_path / "p"), sample=2)
    assert sample.select("id").distinct().count() == 2
    nested = events.groupBy("id").agg(F.collect_list("ed_id").alias("prefix_actions"), F.count(F.lit(1)).alias("n"))
    writers.write_csv(nested, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["id", "n"]


def test_shards_resume(spark, small, tmp_path):
    path = str(tmp_path / "s")
    events = adapters.raw_events(spark, small)
    assert writers.finished_shards(spark, path) == []
    writers.write_sharded(events, path, shards=4, only=[0, 1])
    assert writers.finished_shards(spark, path) == [0, 1]
    writers.write_sharded(events.withColumn("extra", F.lit(1)), path, shards=4, only=[1, 2, 3])
    assert writers.finished_shards(spark, path) == [0, 1, 2, 3]
    back = writers.read_sharded(spark, path)
    assert back.count() == events.count()
    assert set(r.extra for r in back.select("extra").distinct().collect()) == {0, 1}


def test_saved_fit_is_reused_only_with_the_same_parameters(spark, tmp_path):
    path = str(tmp_path / "fit")
    table = spark.createDataFrame([("all", 4, 28, 0.5)], "segment string, from_state long, to_state long, rate double")
    assert output.load_fit(spark, path, {"h": 1}) is None
    output.save_fit(table, path, {"h": 1})
    assert output.load_fit(spark, path, {"h": 1}).collect() == table.collect()
    assert output.load_fit(spark, path, {"h": 2}) is None


def test_submission_keeps_template_order(spark):
    template = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "id string, ordinal long")
    scores = spark.createDataFrame([("a", 1.5), ("b", 0.25), ("z", 0.5)], "id string, p double")
    got = [(r.id, r.order_shipped) for r in output.align_submission(template, scores).collect()]
    assert got == [("b", 0.25), ("a", 1.0), ("c", 0.0)]
