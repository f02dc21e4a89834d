"""The registered queries against their SQL, the pipeline against its stages by hand, and the rest without this subpackage."""

import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimweave.llm import registry

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "pages", "conversations", "benchmark", "embeddings")


def rows(frame):
    names = sorted(frame.columns)
    return sorted(str([r[n] for n in names]) for r in frame.to_dict("records"))


@pytest.mark.parametrize("name", registry.ORACLES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), con.sql(registry.ORACLES[name]).df()
    blank = lambda f: f.astype(object).where(f.notna(), None)
    fix = lambda f: blank(f).map(lambda x: int(x) if isinstance(x, float) and x == int(x) else x)
    assert rows(fix(got)) == rows(fix(want))


def test_pipeline_stages(spark, tmp_path):
    from test_media import classes_by_hand

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, columns = [docs], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SMALL).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept[-1].columns == columns
    texts = [{r.doc_id: r.text for r in k.select("doc_id", "text").collect()} for k in kept[:5]]
    from test_texts import plain_figures

    fails = lambda f: f[0] < 50 or 100 * f[4] > 50 * f[0]
    assert set(texts[1]) == {i for i, t in texts[0].items() if not fails(plain_figures(t or ""))}
    assert set(texts[2]) <= set(texts[1]) and len(texts[2]) > 0.8 * len(texts[1])
    components = classes_by_hand(list(texts[2].items()), 5, 80)
    assert set(texts[3]) == {i for i, (_, c) in components.items() if i == c}
    assert set(texts[4]) <= set(texts[3]) and kept[5].count() == kept[4].count()
    assert kept[5].where(F.col("n_tokens") <= 0).isEmpty()


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in all columns, empty, blank and very long texts, repeated rows and ids, clashing columns, and an empty table."""
    plain = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(plain)] + [(0, plain[0], "en", "src0", 1), (1, plain[2], "en", "src1", 1), (None, plain[3], None, None, None), (None, plain[3], None, None, None), (50, None, "en", "src1", 0), (51, "", "en", "src1", 0), (52, " \n", None, "src1", 2), (53, " ".join(f"long{i}" for i in range(150_000)), "en", "src2", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, dropped long, rejected_host string, row string, tokens long, component string, mark long"
    docs = spark.createDataFrame([(*r, 1, "h", "r", 2, "c", 3) for r in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    counts, now = [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        assert now.columns == docs.columns or k == len(corpus_pipeline.STAGES) - 1
        counts.append(now.count())
        if k == 2:
            kept = [(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()]
            assert sorted(kept) == sorted([(1 if i == 2 else i, t) for i, t in enumerate(plain)] + [(53, rows[-1][1])])
    assert counts[:3] == [45, 45, 41] and counts[3] == counts[4] > 0
    assert corpus_pipeline.bpe_tokens(spark, docs.where("doc_id = 53"), "").first().n_tokens > 150_000
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).isEmpty()


def test_the_rest_imports_without_this_subpackage():
    code = "import sys; sys.modules['claimweave.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q), q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
