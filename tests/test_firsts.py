"""Choosing relations from their outlines, and pages of them."""

from pyspark.sql import functions as F
from test_outlines import pairs
from test_sources import relations

from claimweave.operators import reconcile
from claimweave.plans import paging, views


def test_outlines_give_the_same_choice(spark):
    made = pairs(spark)
    told, found = reconcile.reconcile(made).cache(), reconcile.outlined(made)
    want = {r.case: r.id for r in views.highlights(told).collect()}
    assert {r.case: r.id for r in views.highlights(found).collect()} == want and len(want) == 5
    asked = {"a": ("complementary", {"check": "period-containment", "outcomes": ("pass",)}), "b": ("contradicts", {"check": "as_of", "fall_back": True}), "c": ("corroborates", {"cross_doc": False}), "d": ("supersedes", {"check": "basis", "outcomes": ("fail",)})}
    one = {name: [r.id for r in views.pick(told, verdict, **how).collect()] for name, (verdict, how) in asked.items()}
    assert one["d"] == [] and all(one[k] for k in "abc")
    assert {r.case: [r.id] for r in views.picks(found, asked).collect()} == {k: v for k, v in one.items() if v}


def test_choosing_builds_no_traces(spark):
    plan = views.highlights(reconcile.outlined(pairs(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert "isn't recognised" not in plan and "detail" not in plan


def test_a_task_writes_many_files_of_pages(spark, tmp_path):
    found, path = relations(spark, 1000), f"file://{tmp_path}/pages"
    paging.write_pages(found, path, file_rows=10)
    sizes = [r.n for r in spark.read.parquet(f"{path}/index").orderBy("file").collect()]
    assert sum(sizes) == 1000 == paging.total(spark, path) and max(sizes) == 10
    per_task = spark.read.parquet(f"{path}/index").groupBy(F.shiftright("file", 33)).count().collect()
    assert len(per_task) <= 2  # one for each file before
    assert [r.id for r in paging.page_at(spark, path, 495, 20).collect()] == [r.id for r in found.orderBy(*views.review_order()).collect()][495:515]
    assert not [p for p in tmp_path.joinpath("pages").iterdir() if p.name.startswith("staged")]
