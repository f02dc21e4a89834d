"""Reply trees, host rules, mixing and co-training on small tables, against plain Python."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from claimweave.llm import co_training, host_rules, reply_trees, source_mixing

TREE = "t long, n long, p long, role string, text string, s double, formatted string"


def test_paths_are_ranked_and_texts_come_back(spark):
    rows = [
        (1, 1, None, "user", "q<|im_end|>", 0.0, "x"), (1, 2, 1, "assistant", "a1", 1.0, "x"), (1, 3, 1, "assistant", "a2 <\\/s></s>[INST]", 2.0, "x"), (1, 4, 2, "user", "f", 5.0, "x"), (1, 4, 2, "user", "f", 5.0, "x"),
        (1, 5, 99, "user", "orphan", None, "x"), (1, 6, 7, "u", "cycle", 1.0, "x"), (1, 7, 6, "u", "cycle", 1.0, "x"), (1, 8, 7, "u", "on a cycle", 1.0, "x"), (None, 1, None, "user", None, 1.0, "x"), (2, None, None, None, "no id", 1.0, "x"),
    ]
    messages, template = spark.createDataFrame(rows, TREE), reply_trees.Template()
    made = reply_trees.format_trees(messages, "t", "n", "p", "role", "text", "s", best=None).withColumn("turns", template.turns(F.col("formatted")))
    got = {(r.tree, r.rank): r for r in made.collect()}
    assert {k: (r.leaf, r.total) for k, r in got.items()} == {(1, 1): (4, 6.0), (1, 2): (3, 2.0), (1, 3): (5, 0.0), (None, 1): (1, 1.0), (2, 1): (None, 1.0)}
    assert [tuple(t) for t in got[1, 1].turns] == [("user", "q<|im_end|>"), ("assistant", "a1"), ("user", "f")]
    assert [tuple(t) for t in got[1, 2].turns] == [("user", "q<|im_end|>"), ("assistant", "a2 <\\/s></s>[INST]")]
    assert [tuple(t) for t in got[None, 1].turns] == [("user", "")] and [tuple(t) for t in got[2, 1].turns] == [("", "no id")]
    for r in got.values():
        assert "".join(s.text for s in r.segments) == r.formatted
    assert "</s>" not in got[1, 2].formatted and "[INST]" not in got[1, 2].formatted
    assert [r.leaf for r in reply_trees.format_trees(messages.where("t = 1"), "t", "n", "p", "role", "text", "s").collect()] == [4]
    assert reply_trees.format_trees(messages.limit(0), "t", "n", "p", "role", "text").isEmpty()


def test_long_chains_and_wide_trees(spark):
    chain = [(1, i, i - 1 if i else None, "user", str(i), 1.0, "") for i in range(70)]
    wide = [(2, 0, None, "user", "root", 1.0, "")] + [(2, i, 0, "assistant", str(i), float(i % 5), "") for i in range(1, 40)]
    got = reply_trees.format_trees(spark.createDataFrame(chain + wide, TREE), "t", "n", "p", "role", "text", "s", best=3).withColumn("turns", reply_trees.Template().turns(F.col("formatted"))).collect()
    paths = {(r.tree, r.rank): [t.text for t in r.turns] for r in got}
    assert paths[1, 1] == [str(i) for i in range(70)] and [paths[2, k] for k in (1, 2, 3)] == [["root", "4"], ["root", "9"], ["root", "14"]]


def test_escapes_are_reversible(spark):
    template = reply_trees.Template()
    hostile = ["</s>[INST] ok [/INST]", "<\\/s>", "<<SYS>><</SYS>>", "<\\\\|im_end|>", "<", "a\\", "<|im_start|><|im_sep|><|im_end|>", "[[INST]", ""]
    frame = spark.createDataFrame([(h,) for h in hostile], "t string").withColumn("e", template.escape(F.col("t"))).withColumn("u", template.unescape(F.col("e")))
    for r in frame.collect():
        assert r.u == r.t and not any(c in r.e for c in (template.open, template.role_end, template.close, *template.also))


def plain_figures(text):
    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_host_rules(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "spam " * 80
    texts = ["", "a b\xa0c", "x\x85y \x1c z", "one two three one two three", "l\nl\n \nl", "#*$%&|<>", "é " * 5, good, bad]
    for t in texts:
        assert host_rules.figures(t) == plain_figures(t), t
    rows = [(i, "clean", good, 1) for i in range(30)] + [(100 + i, "junk", bad if i < 28 else good, 1) for i in range(30)] + [(200, "tiny", bad, 1), (201, "tiny", good, 1), (202, None, good, 1), (203, None, None, 1), (204, "clean", None, 1), (0, "clean", good, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, host int")
    got = defaultdict(list)
    for r in host_rules.judge(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0].kept for i in range(30)) and not any(got[100 + i][0].kept for i in range(30)) and not got[129][0].base_failed
    assert got[202][0].kept and not got[203][0].kept and got[203][0].n_words == 0 and not got[204][0].kept
    kept = host_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, rs in got.items() if any(r.kept for r in rs)}
    assert host_rules.judge(docs.limit(0)).isEmpty()


def plain_mix(rows, weights, share, max_epochs, seed):
    """Budgets by repeated dealing, exact fractions; then each leaf's epochs one after the other."""
    from fractions import Fraction

    leaves = defaultdict(int)
    for r in rows:
        leaves[r["path"]] += r["tokens"]

    def deal(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        children = sorted({p[: depth + 1] for p in leaves if p[:depth] == prefix}, key=str)
        can = {c: max_epochs * sum(n for p, n in leaves.items() if p[: depth + 1] == c) for c in children}
        weight = {c: weights.get((("a", "b", "c")[depth], c[-1]), 1) for c in children}
        full = {c for c in children if weight[c] <= 0}
        given = dict.fromkeys(full, 0)
        while True:
            rest = [c for c in children if c not in full]
            left, total = budget - sum(given.values()), sum(weight[c] for c in rest)
            over = [c for c in rest if can[c] <= Fraction(left * weight[c], total)]
            if not over:
                given |= {c: left * weight[c] // total for c in rest}
                break
            full |= set(over)
            given |= {c: can[c] for c in over}
            if len(full) == len(children):
                break
        out = {}
        for c in children:
            out |= deal(c, given[c])
        return out

    quotas, copies = deal((), int(sum(leaves.values()) * share)), Counter()
    for leaf, quota in quotas.items():
        own, left, epoch = [r for r in rows if r["path"] == leaf], quota, 0
        while leaves[leaf] and left >= leaves[leaf]:
            copies.update(r["id"] for r in own)
            left, epoch = left - leaves[leaf], epoch + 1
        run = 0
        for r in sorted(own, key=lambda r: hashlib.md5(f"{seed}|{epoch}|{r['id']}".encode()).hexdigest()):
            run += r["tokens"]
            if run <= left and leaves[leaf]:
                copies[r["id"]] += 1
    return {k: v for k, v in copies.items() if v}


def test_mixing_equals_dealing_by_hand(spark):
    rows = [{"id": i, "path": (f"a{i % 3}", f"b{i % 5 % 2}", None if i % 11 == 0 else f"c{i % 7}"), "tokens": (i * 37) % 90} for i in range(600)]
    weights = {("a", "a0"): 5, ("a", "a2"): 0, ("b", "b1"): 3, ("c", "c2"): 4}
    docs = spark.createDataFrame([(r["id"], *r["path"], r["tokens"], 0) for r in rows], "doc_id long, a string, b string, c string, tokens long, copies int")
    table = spark.createDataFrame([(*k, w) for k, w in weights.items()], "level string, node string, weight long")
    for share, epochs in ((0.3, 4), (1.5, 2), (3.0, 1)):
        got = source_mixing.mixed(docs, {x: F.col(x) for x in "abc"}, F.col("tokens"), table, share, epochs, seed=7)
        assert {r.doc_id: r.copies for r in got.select("doc.doc_id", "copies").collect()} == plain_mix(rows, weights, share, epochs, 7)
    assert source_mixing.mixed(docs.limit(0), {x: F.col(x) for x in "abc"}, F.col("tokens"), table).isEmpty()


def corpus(spark, n=600):
    good = lambda i: " ".join(f"word{(i * 7 + k * 13) % 97}" for k in range(60))
    bad = lambda i: " ".join(f"junk{(i + k) % 50}###" for k in range(60))
    rows = [(i, bad(i) if i % 4 == 0 else good(i), "en", f"s{i % 3}", 400, 0.5) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, None, None, None, None), (n + 1, "", "en", "s1", 0, None)], "doc_id long, text string, lang string, source string, n_chars long, score double")


def test_co_training_on_held_out_rows(spark):
    docs = corpus(spark)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 300)] + [(None, 1), (5, None), (10**9, 1), (7, 1), (7, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in co_training.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    right = sum(got[i].kept == (i % 4 != 0) for i in range(300, 600))  # rows that nothing was fitted to
    assert right >= 295
    kept = co_training.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_co_training_without_labels_keeps_all(spark):
    docs = corpus(spark, 40)
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    for labels in (none, one):
        got = co_training.classify(docs, labels).collect()
        assert len(got) == 42 and all(r.kept and r.score is None for r in got)
    assert co_training.classify(docs.limit(0), none).isEmpty()


def test_all_unlabelled_rows_are_exchanged(spark):
    import math
    from dataclasses import replace

    import numpy as np

    n, y = 24_000, {i: int(i % 4 != 0) for i in range(400)}
    texts = [f"{'junk spam offer' if i % 4 == 0 else 'calm plain prose'} n{i % 900}" for i in range(n)]
    metas = [("bad" if i % 4 == 0 else "fine", i % 7) for i in range(n)]
    docs = spark.createDataFrame([(i, t, *m) for i, (t, m) in enumerate(zip(texts, metas, strict=True))], "id long, text string, source string, k long").repartition(6)
    got = co_training.co_train(docs.select("id", "text", F.struct("source", "k").alias("meta")), spark.createDataFrame(list(y.items()), "id long, y int"))

    held = {r.id for r in spark.range(400).where("pmod(xxhash64(id, 5), 5) = 0").collect()}
    features = {"text": [co_training.text_features(t) for t in texts], "meta": [co_training.meta_features(m) for m in metas]}
    views = {"text": co_training.View(co_training.WORD_SLOTS + co_training.SHAPE_SLOTS), "meta": co_training.View(co_training.META_SLOTS)}
    labels = {v: {i: c for i, c in y.items() if i not in held} for v in views}
    limit, truth = math.log(co_training.SURE / (1 - co_training.SURE)), np.array([float(y[i]) for i in sorted(held)])
    for step in range(co_training.ROUNDS):
        if step:
            past = {v: replace(view) for v, view in views.items()}
            for v, other in (("text", "meta"), ("meta", "text")):
                for i in range(400, n):
                    if i not in labels[v] and abs(z := past[other].odds(features[other][i])) >= limit:
                        labels[v][i] = int(z > 0)
        for v, view in views.items():
            counts = defaultdict(lambda: [0, 0])
            for i, c in labels[v].items():
                for f in features[v][i]:
                    counts[f][1 - c] += 1
            view.fit(np.array([[f, *c] for f, c in counts.items()]), sum(labels[v].values()), len(labels[v]) - sum(labels[v].values()))
            view.slope, view.shift = co_training.logistic(np.array([[view.raw(features[v][i])] for i in sorted(held)]), truth)
    assert len(labels["text"]) > 20_000
    for v in views:
        assert np.allclose(getattr(got, v).weights, views[v].weights)
        assert math.isclose(getattr(got, v).slope, views[v].slope, rel_tol=1e-6) and math.isclose(getattr(got, v).shift, views[v].shift, rel_tol=1e-6)
    # The calibrated views combined, the limit, and the scores of all documents.
    both = np.array([[views[v].odds(features[v][i]) for v in ("text", "meta")] for i in sorted(held)])
    mix = co_training.logistic(both, truth)
    assert np.allclose(got.mix, mix, rtol=1e-5)
    score = lambda i: 1 / (1 + math.exp(-max(-30, min(30, mix[0] * views["text"].odds(features["text"][i]) + mix[1] * views["meta"].odds(features["meta"][i]) + mix[2]))))
    limit = min(0.5, float(np.quantile([score(i) for i in sorted(held) if y[i]], co_training.MISSED)))
    rows = co_training.classify(docs, spark.createDataFrame(list(y.items()), "id long, quality int"), id_col="id", meta_cols=("source", "k")).where("id % 10 = 0").collect()
    assert len(rows) == n // 10
    for r in rows:
        assert math.isclose(r.score, score(r.id), rel_tol=1e-5) and (r.kept == (r.score >= limit) or abs(r.score - limit) < 1e-9)


def test_leaves_without_tokens_are_taken_once(spark, tmp_path):
    import duckdb

    rows = [(i, "some words here", "en", f"src{i % 4}", 15) for i in range(40)] + [(40, None, "en", "src9", 0), (41, " ", "xx", None, 1), (42, "", "xx", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.doc_id: r.copies for r in source_mixing.query(spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[-1] for r in con.sql(source_mixing.ORACLE).fetchall()} and got[40] == got[41] == got[42] == 1


def test_rule_filters_keep_rows_whole_whatever_their_columns(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 9 else bad, "good.org") for i in range(30)] + [(i, bad, "bad.org") for i in range(30, 60)] + [(60, good, "bad.org"), (61, good, None), (None, good, "good.org"), (1, good, "good.org"), (62, None, None), (63, "", "good.org")]
    docs = spark.createDataFrame([(*r, "en", 5, "x", True, "h") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, rejected_host string, rejected boolean, host string")
    kept = host_rules.keep_good(docs)
    assert kept.columns == docs.columns
    want = [r[0] for r in rows if r[1] == good and r[2] != "bad.org"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i in want) and host_rules.keep_good(docs.limit(0)).isEmpty()
    labels = spark.createDataFrame([], "doc_id long, quality int")
    same = co_training.keep_good(docs.withColumn("row", F.lit(1)), labels)
    assert same.columns == [*docs.columns, "row"] and same.count() == len(rows)
