"""Stored relations follow claims that come, change, move and go: they equal those of a full run, and only touched parts are read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from claimweave.operators import reconcile
from claimweave.plans import changes, pipeline
from claimweave.plans.samples import finished
from claimweave.sources.store import Store, VersionTaken, bounded

RAW = "id string, doc_id string, subject_raw string, measure_raw string, low double, high double, unit_raw string, period_label string, scope string, value_kind string, confidence double"


def made(spark, rows):
    """Claims from (id, document, subject, measure, value, period, confidence)."""
    return finished(spark.createDataFrame([(i, d, s, m, float(v), float(v), "USD million", p, "group", "number", c) for i, d, s, m, v, p, c in rows], RAW))


def said(relations):
    return {(r.claim_a_id, r.claim_b_id): (r.verdict, r.confidence, r.cross_doc) for r in relations.collect()}


@pytest.mark.parametrize("cap", [400, 3])
def test_relations_are_those_of_a_full_run(spark, tmp_path, cap):
    r = random.Random(cap)
    store = Store(spark, str(tmp_path), buckets=8)
    periods = ["FY2021", "FY2022", "Q2 FY2022", "H1 FY2021", None]
    row = lambda i: (f"c{i}", f"d{i % 4}", r.choice(["North Mill", "South Mill"]), r.choice(["output", "net cash flow"]), r.choice([10, 10, 11, 40]), r.choice(periods), r.choice([0.5, 0.9]))
    now = {i: row(i) for i in range(14)}
    steps = [(dict(now), []), ({20: row(20), 21: row(21)}, []), ({3: row(3), 4: now[4], 5: row(5)}, []), ({}, [1, 2, 21, 99]), ({6: (*now[6][:2], "East Mill", *now[6][3:])}, [6]), ({30: ("c30", "d9", "West Mill", "net cash flow", -5, "FY2021", 0.7)}, []), ({}, [30])]
    now = {}
    for put, gone in steps:
        frame = made(spark, put.values()) if put else store.read("claims").limit(0)
        now = {k: v for k, v in now.items() if k not in gone} | put
        changes.apply(store, frame, spark.createDataFrame([(f"c{i}",) for i in gone], "id string"), cap)
        assert {x.id for x in store.read("claims").collect()} == {v[0] for v in now.values()}
        assert said(store.read("relations")) == said(reconcile.reconcile(made(spark, now.values()), cap))
    changes.apply(store, made(spark, now.values()), None, cap)
    assert said(store.read("relations")) == said(reconcile.reconcile(store.read("claims"), cap))


def test_a_measure_that_turns_negative_withdraws_contradictions_elsewhere(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    changes.apply(store, made(spark, [("a", "d", "North Mill", "cash flow", 10, "FY2021", 0.5), ("b", "e", "North Mill", "cash flow", 30, "Q1 FY2021", 0.5)]))
    assert said(store.read("relations")) == {("a", "b"): ("contradicts", 0.85, True)}
    changes.apply(store, made(spark, [("c", "d", "Other Works", "cash flow", -1, "FY2021", 0.5)]))
    assert said(store.read("relations")) == {("a", "b"): ("complementary", 0.9, True)}
    changes.apply(store, store.read("claims").limit(0), spark.createDataFrame([("c",)], "id string"))
    assert said(store.read("relations")) == {("a", "b"): ("contradicts", 0.85, True)}


def test_a_forced_ingest_changes_verdicts(spark, tmp_path):
    """Two documents agree; then the model reads another figure in one of them, and then none at all."""
    from test_engine import provider, write

    files = tmp_path / "files"
    files.mkdir()
    write(files, "one.txt", "5310.0 Rs. Cr")
    write(files, "two.txt", "53098.2 INR million")
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    pipeline.ingest(spark, store, str(files), provider)
    assert [x.verdict for x in store.read("relations").collect()] == ["corroborates"]
    store.write("responses", store.read("responses").limit(0))
    other = lambda prompt: (provider(prompt) or "").replace('"value": 5310.0', '"value": 7777.0')
    pipeline.ingest(spark, store, str(files), other, force=True)
    assert [x.verdict for x in store.read("relations").collect()] == ["contradicts"] and sorted(x.low for x in store.read("claims").collect()) == [7777.0, 53098.2]
    store.write("responses", store.read("responses").limit(0))
    silent = lambda prompt: '{"claims": []}' if "5310" in prompt and "doc_type" not in prompt else provider(prompt)
    pipeline.ingest(spark, store, str(files), silent, force=True)
    assert store.read("relations").isEmpty() and store.read("claims").count() == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_touched_buckets_are_read_and_stored_rows_not_shuffled(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=16)
    changes.apply(store, made(spark, [(f"c{i}", "d", f"Subject {i}", "output", i, "FY2021", 0.5) for i in range(60)]))
    new = made(spark, [("x", "e", "Subject 7", "output", 8, "FY2021", 0.5)])
    where = store.buckets_of("claims", spark.createDataFrame([("c7",)], "id string"))
    assert len(where) == 1
    stored = store.read("claims", where)
    assert {f.split("bucket=")[1].split("/")[0] for f in stored.inputFiles()} >= {str(where[0])}
    joined = stored.join(bounded(new.select("subject_key").distinct()), "subject_key", "left_semi")
    plan = plan_of(joined)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    _, before, _, _ = changes.touched(store, new, bounded(new.select("id")))
    assert {x.id for x in before.collect()} == {"c7"}


def test_moved_claims_leave_their_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=32)
    first = made(spark, [("a", "d", "North Mill", "output", 1, "FY2021", 0.5)])
    changes.apply(store, first)
    (was,) = store.buckets_of("claims", first.select("id"))
    changes.apply(store, made(spark, [("a", "d", "Quite Another", "output", 1, "FY2021", 0.5)]))
    assert store.read("claims", [was]).isEmpty() and [x.subject_raw for x in store.read("claims").collect()] == ["Quite Another"]


def test_two_writers_lose_no_row(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    rows = lambda *keys: spark.createDataFrame([(k, k) for k in keys], "key string, response string")
    one.upsert("responses", rows("a"))
    stale = one._versions("responses")
    two.upsert("responses", rows("b"))
    one._versions = lambda name, own=iter([stale]): next(own, None) or Store._versions(one, name)
    one.upsert("responses", rows("c"))  # comes to the number that the other took
    assert {x.key for x in two.read("responses").collect()} == {"a", "b", "c"}
    one._versions = lambda name: stale
    with pytest.raises(VersionTaken):
        one.write("responses", rows("d"))
    assert {x.key for x in two.read("responses").collect()} == {"a", "b", "c"}


def test_tombstones_and_what_is_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = lambda name, title: spark.createDataFrame([("x", name, title)], "doc_id string, filename string, title string")
    store.upsert("documents", row("first.txt", "1"))
    store.upsert("documents", row("second.txt", "2"))
    assert [(x.filename, x.title) for x in store.read("documents").collect()] == [("first.txt", "2")]
    store.upsert("documents", row("", "").limit(0), gone=row("first.txt", "2"))
    assert store.read("documents").isEmpty()
    store.upsert("documents", row("third.txt", "3"))
    store.upsert("documents", row("fourth.txt", "4"))
    assert [(x.filename, x.title) for x in store.read("documents").collect()] == [("third.txt", "4")]


def test_hot_blocks_are_grids(spark, monkeypatch):
    """A block of many claims makes each pair once, over all tasks."""
    monkeypatch.setattr(reconcile, "CELL", 40)
    hot = made(spark, [(f"c{i:03d}", f"d{i % 3}", "North Mill", "output", i % 5, "FY2021", 0.5) for i in range(150)] + [(f"s{i}", "d", "South Mill", "output", i, "FY2021", 0.5) for i in range(3)])
    blocked = reconcile.with_blocks(hot)
    pairs = reconcile.block_pairs(blocked).select("a_id", "b_id")
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) == 150 * 149 // 2 + 3 and all(a < b for a, b in got)
    assert pairs.repartition("a_id").select(F.spark_partition_id()).distinct().count() > 1
    new, old = blocked.where("id < 'c060'"), blocked.where("id >= 'c060'")
    across = [tuple(r) for r in reconcile.incremental_pairs(new, old).select("a_id", "b_id").collect()]
    assert len(across) == len(set(across)) == 60 * 59 // 2 + 60 * 90


def test_cells_of_a_hot_block_go_to_several_tasks(spark, monkeypatch):
    """As the join deals them, where adaptive execution doesn't put small partitions together again."""
    hot = made(spark, [(f"c{i:03d}", f"d{i % 3}", "North Mill", "output", i % 5, "FY2021", 0.5) for i in range(150)])
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    tasks = {}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for cell in (40, 1000):
            monkeypatch.setattr(reconcile, "CELL", cell)
            tasks[cell] = reconcile.block_pairs(reconcile.with_blocks(hot)).select(F.spark_partition_id()).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks[40] > 1 and tasks[1000] == 1
