"""Streams over several batches must end at the batch answer."""

import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from deckloom.operators.gates import budget_breach
from deckloom.session import shared_dir
from deckloom.sources.sinks import folders
from deckloom.streaming import events as ev
from deckloom.streaming.templates import import_templates, ingest_templates

c = F.col
SF = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def log(spark, tmp_path):
    """The events as files of rising sequence, one micro-batch each."""
    e = spark.read.parquet(SF)
    kind = c("event_type")
    table = e.select(
        (c("user_id") % 7).alias("job_id"), c("event_id").alias("sequence"), c("ts").alias("created_at"),
        F.when(kind == "view", "running").when(kind == "purchase", "succeeded").when(kind == "error", "failed")
        .otherwise("reviewing").alias("status"),
        F.when(kind == "click", c("value") / 20).alias("progress"), kind.alias("stage"),
        F.floor(c("value") * 100).cast("bigint").alias("input_tokens"), F.floor(c("value") * 7).cast("bigint").alias("output_tokens"))
    path = str(tmp_path / "log")
    for i in range(4):
        table.filter(F.floor(c("sequence") / 260) == i).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def test_tail(spark, log):
    path, batch = log
    out = shared_dir(spark, "test-tail")
    ev.tail_stream(ev.event_stream(spark, path, 1), f"{out}/log", f"{out}/ck")
    stored = spark.read.parquet(f"{out}/log")
    assert stored.select("batch").distinct().count() > 1
    # A repeated event counts once.
    got = ev.tail_events(stored.drop("batch").unionByName(batch.limit(5)), 3)
    assert rows(got, "job_id", "sequence") == rows(ev.tail_events(batch, 3), "job_id", "sequence")
    ends = got.groupBy("job_id").agg(F.count_if(c("status").isin(ev.TERMINAL)).alias("n"))
    assert {r.n for r in ends.collect()} == {1}


def test_job_state(spark, log):
    path, batch = log
    out = shared_dir(spark, "test-state")
    ev.job_state_stream(ev.event_stream(spark, path, 1), f"{out}/state", f"{out}/ck")
    got = ev.read_job_state(spark, f"{out}/state")
    cols = ["job_id", "last_sequence", "status", "progress", "stage", "started_at", "finished_at"]
    assert rows(got, *cols) == rows(ev.job_state(batch), *cols)
    assert all(0 <= r.progress <= 1 for r in got.collect())


def test_spend(spark, log):
    path, batch = log
    out = shared_dir(spark, "test-spend")
    ev.spend_monitor(ev.event_stream(spark, path, 1), 0.5, f"{out}/spend", f"{out}/ck")
    want = budget_breach(batch, 0.5).filter("breach_at is not null")
    assert rows(ev.read_breaches(spark, f"{out}/spend"), "job_id", "breach_at", "spent_usd") == rows(
        want, "job_id", "breach_at", "spent_usd")
    assert ev.read_late(spark, f"{out}/spend").count() == 0
    # Rows once more, in a later batch: all of them are late, nothing is counted twice.
    again = spark.read.parquet(path).limit(40).cache()
    seen = again.select("job_id", "sequence").distinct().count()
    again.coalesce(1).write.mode("append").parquet(path)
    ev.spend_monitor(ev.event_stream(spark, path, 1), 0.5, f"{out}/spend", f"{out}/ck")
    assert ev.read_late(spark, f"{out}/spend").count() == seen
    assert rows(ev.read_breaches(spark, f"{out}/spend"), "job_id", "breach_at") == rows(want, "job_id", "breach_at")
    state = spark.read.format("statestore").option("stateVarName", "spend").load(f"{out}/ck")
    assert state.count() == batch.select("job_id").distinct().count()


def test_job_state_folders_stay_few(spark, tmp_path, table):
    """Twenty batches, a restart before each, and the last merge done twice."""
    path, out = str(tmp_path / "log"), shared_dir(spark, "test-merge")
    schema = "job_id int, sequence bigint, created_at timestamp, status string, progress double, stage string"
    now = datetime.datetime(2024, 1, 1)
    data = [[(j, 10 * i + j, now, "running" if i < 19 else "succeeded", i / 20, f"s{i}") for j in range(i % 3, 5)] for i in range(20)]
    for part in data:
        table(part, schema).coalesce(1).write.mode("append").parquet(path)
        ev.job_state_stream(ev.event_stream(spark, path, 1), f"{out}/state", f"{out}/ck")
    cols = ["job_id", "last_sequence", "status", "progress", "stage", "started_at", "finished_at"]
    want = rows(ev.job_state(spark.read.parquet(path)), *cols)
    assert rows(ev.read_job_state(spark, f"{out}/state"), *cols) == want
    assert len(folders(spark, f"{out}/state/changes")) + len(folders(spark, f"{out}/state/merged")) <= 2 * ev.MERGE_EVERY + 2
    ev._newest_rows(spark, f"{out}/state", 15).write.mode("overwrite").parquet(f"{out}/state/merged/batch=15")
    assert rows(ev.read_job_state(spark, f"{out}/state"), *cols) == want


def test_template_import(spark, tmp_path, table):
    schema = "template_id bigint, sha256 string, phash string, slide_count int, archetypes array<string>"
    first = [(1, "a", "00000000000000ff", 2, ["title", "chart"]), (2, "a", "ffffffffffffffff", 2, ["title", "chart"]),
             (3, "b", "00000000000000fe", 2, ["title"]), (4, "c", "00000000000000fe", 3, ["title", "chart"]), (5, "d", None, 1, ["table"])]
    second = [(6, "d", None, 1, ["table"]), (7, "e", "0000000000000ff0", 2, ["title", "chart"]), (8, "f", "00000000000000f7", 2, ["chart"]),
              (9, "g", None, 9, ["title", "title", "chart", "chart"])]
    path, out = str(tmp_path / "decks"), shared_dir(spark, "test-import")
    table(first, schema).coalesce(1).write.parquet(path)
    ingest_templates(ev.event_stream(spark, path, 1), f"{out}/catalog", f"{out}/ck")
    table(second, schema).coalesce(1).write.mode("append").parquet(path)
    ingest_templates(ev.event_stream(spark, path, 1), f"{out}/catalog", f"{out}/ck")
    kept = spark.read.parquet(f"{out}/catalog/templates")
    assert rows(kept, "template_id") == [(1,), (4,), (5,), (7,), (9,)]
    dup = spark.read.parquet(f"{out}/catalog/duplicates")
    assert rows(dup, "template_id", "existing_id", "kind") == [(2, 1, "exact"), (3, 1, "near"), (6, 5, "exact"), (8, 1, "near")]
    family = {r.template_id: r.family_id for r in kept.collect()}
    # Equal signatures of one batch share a family; its four slides then match a deck of four.
    assert family[1] == family[4] == family[9] and family[5] != family[1]
    # One title and one chart against two of each is only half.
    assert family[7] != family[1]
    # A chain of hashes four bits apart: the second is near to the first, the third only to the second.
    chain = table([(1, "a", "0000000000000000", 2, ["title"]), (2, "b", "000000000000000f", 2, ["title"]), (3, "c", "00000000000000ff", 2, ["title"]),
                   (4, "d", "0000000000000fff", 2, ["title"]), (5, "e", "000000000000ffff", 2, ["title"])], schema)
    kept, near = import_templates(chain.drop("archetypes"), chain.select("template_id", F.explode("archetypes").alias("archetype")), None, None)
    assert rows(kept, "template_id") == [(1,), (3,), (5,)] and rows(near, "template_id", "existing_id") == [(2, 1), (4, 3)]
    # The same decks in one batch: nobody can match a family that is only being made.
    both = table(first + second, schema)
    accepted, _ = import_templates(both.drop("archetypes"), both.select("template_id", F.explode("archetypes").alias("archetype")), None, None)
    assert rows(accepted, "template_id") == [(1,), (4,), (5,), (7,), (9,)]


def test_spend_of_one_job_needs_no_frames():
    """Rows of a job come as rows: the least cost of a repeated sequence counts, late rows change nothing, a breach comes once."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    held = []
    spend = ev._Spend(10)
    spend.spend = SimpleNamespace(get=lambda: held[-1] if held else None, update=held.append, exists=lambda: bool(held))

    def feed(*pairs):
        return [tuple(r) for r in spend.handleInputRows((1,), iter([Row(sequence=s, micro=m) for s, m in pairs]), None)]

    assert feed((3, 5), (2, 4), (3, 9)) == [] and held == [(3, 9, False)]
    assert feed((3, 1), (5, 1), (6, 1), (7, 1)) == [(1, "late", 3, None), (1, "breach", 6, 11)] and held[-1] == (7, 12, True)
    assert feed((8, 20)) == [] and feed((1, 1)) == [(1, "late", 1, None)] and held[-1] == (8, 32, True)
