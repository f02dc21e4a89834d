"""Pages of text files by chunks, against reading them whole; pages of relations, against OFFSET; one scan for the audit."""

import io
import random

import pytest
from pyspark.sql import functions as F

from claimweave.operators import reconcile
from claimweave.plans import paging, views
from claimweave.plans.samples import finished
from claimweave.sources import pages as sources


def test_every_page_starts_in_one_chunk():
    r = random.Random(1)
    for _ in range(300):
        raw = b"".join(r.choice([b"\f", b"a", b"bc", b"\n", "é".encode()]) for _ in range(r.randint(0, 40)))
        cut = sorted({0, len(raw) + 1, *(r.randint(1, len(raw) + 1) for _ in range(r.randint(0, 6)))})
        sources.STEP = r.choice([1, 2, 7, 1 << 20])
        found = [p for a, b in zip(cut, cut[1:], strict=False) for p in sources.pages_between(io.BytesIO(raw), a, b)]
        assert found == raw.split(b"\f"), (raw, cut)
    sources.STEP = 1 << 20


def test_text_files_by_chunks_equal_whole_ones(spark, tmp_path):
    r = random.Random(2)
    words = lambda n: " ".join(r.choice(["alpha", "beta\n", "ñandú", "7"]) for _ in range(n))
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / f"f{k}.txt").write_text("\f".join(words(r.randint(0, 60)) for _ in range(r.randint(1, 9))))
    (tmp_path / "in" / "copy.txt").write_bytes((tmp_path / "f1.txt").read_bytes())
    (tmp_path / "bad.txt").write_bytes(b"\n \n title \n\xff\xc3\f\f")
    (tmp_path / "other.md").write_text("no")
    want_documents, want_pages = sources.read_documents(spark, str(tmp_path))
    documents, pages = sources.read_text_documents(spark, str(tmp_path), chunk=100)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(pages.select("doc_id", "title", "page_no", "text", "printed_page")) == rows(want_pages.select("doc_id", "title", "page_no", "text", "printed_page"))
    name = lambda df: rows(df.select("doc_id", "filename", "sha256", F.element_at(F.split("path", "/"), -2).alias("folder")))
    assert name(documents) == name(want_documents)
    (tmp_path / "in" / "empty.txt").write_text("")  # a document of one empty page, which whole binaries leave out
    assert [tuple(x) for x in sources.read_text_documents(spark, str(tmp_path / "in" / "empty.txt"))[1].select("page_no", "text", "title").collect()] == [(1, "", None)]
    assert spark.read.format("formfeed_pages").option("chunk", 100).load(str(tmp_path)).rdd.getNumPartitions() > 10


def relations(spark, n):
    rows = [(f"{k * 7919 % n:05d}", "a", "b", reconcile_verdict(k), (0.4, 0.85, 0.9)[k % 3], k % 5 == 0) for k in range(n)]
    return spark.createDataFrame(rows, "id string, claim_a_id string, claim_b_id string, verdict string, confidence double, cross_doc boolean")


def reconcile_verdict(k):
    return ("contradicts", "corroborates", "supersedes", "complementary", "underspecified")[k * k % 5]


def test_pages_equal_offsets_and_read_few_files(spark, tmp_path):
    found, path = relations(spark, 1000), f"file://{tmp_path}/pages"
    paging.write_pages(found, path, file_rows=60)
    want = [r.id for r in found.orderBy(*views.review_order()).collect()]
    got, cursor = [], None
    while page := paging.page_after(spark, path, cursor, 130).collect():
        got += [r.id for r in page]
        cursor = page[-1]
    assert got == want
    for offset in (0, 1, 59, 60, 500, 940, 999, 1000, 5000):
        page = paging.page_at(spark, path, offset, 70)
        assert [r.id for r in page.collect()] == want[offset : offset + 70]
    assert len(paging.page_at(spark, path, 500, 50).inputFiles()) > 5  # of the table, before pruning
    plan = paging.page_at(spark, path, 500, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(file" in plan or "PartitionFilters: [file" in plan
    with pytest.raises(ValueError):
        paging.page_after(spark, path, None, 501)
    paging.write_pages(found.limit(0), path)
    assert paging.page_after(spark, path).isEmpty() and paging.page_at(spark, path, 3).isEmpty()


def test_audit_scans_claims_once(spark, tmp_path):
    raw = [(f"c{k}", "d", "Mill", "output", float(k), float(k), "florins" if k % 3 else "USD", None, "number") for k in range(30)]
    finished(spark.createDataFrame(raw, "id string, doc_id string, subject_raw string, measure_raw string, low double, high double, unit_raw string, period_label string, value_kind string")).write.parquet(str(tmp_path / "claims"))
    counted = views.tallies(spark.read.parquet(str(tmp_path / "claims")))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert {(r.audit, r.a): r.n for r in counted.where("audit = 'unknown_units' or a = 'no_scope'").collect()} == {("unknown_units", "florins"): 20, ("missing_qualifiers", "no_scope"): 30}


def test_reconcile_of_hot_blocks_equals_small_ones(spark, monkeypatch):
    raw = [(f"c{k:02d}", f"d{k % 4}", "Mill", "output", float(k % 6), float(k % 6), "USD", "FY2020", "number") for k in range(40)]
    hot = finished(spark.createDataFrame(raw, "id string, doc_id string, subject_raw string, measure_raw string, low double, high double, unit_raw string, period_label string, value_kind string"))
    want = {(r.claim_a_id, r.claim_b_id, r.verdict) for r in reconcile.reconcile(hot, cap=None).collect()}
    monkeypatch.setattr(reconcile, "CELL", 7)
    assert {(r.claim_a_id, r.claim_b_id, r.verdict) for r in reconcile.reconcile(hot, cap=None).collect()} == want and len(want) == 780
