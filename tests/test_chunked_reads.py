"""Text files whose chunks are much smaller than what a task reads."""

import io
import random

from claimweave.sources import pages as sources


def test_pages_know_where_they_start():
    r = random.Random(3)
    for _ in range(300):
        raw = b"".join(r.choice([b"\f", b"a", b"bc", "é".encode()]) for _ in range(r.randint(0, 40)))
        cut = sorted({0, len(raw) + 1, *(r.randint(1, len(raw) + 1) for _ in range(r.randint(0, 6)))})
        found = [x for a, b in zip(cut, cut[1:], strict=False) for x in sources.placed_pages(io.BytesIO(raw), a, b)]
        assert [page for _, page in found] == raw.split(b"\f") and all(raw[at : at + len(page)] == page for at, page in found)


def test_a_task_reads_many_chunks(spark, tmp_path):
    (tmp_path / "large.txt").write_text("\f".join(f"page {k}" for k in range(5000)))
    for k in range(20):
        (tmp_path / f"small{k}.txt").write_text(f"file {k}\fend")
    _, pages = sources.read_text_documents(spark, str(tmp_path), chunk=50)
    assert sorted(r.page_no for r in pages.where("title = 'page 0'").collect()) == list(range(1, 5001))
    source = spark.read.format("formfeed_pages").option("chunk", 50).option("task", 1 << 20)
    assert source.load(str(tmp_path)).rdd.getNumPartitions() <= 22  # chunk by chunk there are over 900
    assert source.option("show", "first").load(str(tmp_path)).count() == 21
    want = {(r.path, r.chunk, r.place, r.text) for r in spark.read.format("formfeed_pages").option("chunk", 50).load(str(tmp_path)).collect()}
    assert {(r.path, r.chunk, r.place, r.text) for r in source.option("show", "all").load(str(tmp_path)).collect()} == want
