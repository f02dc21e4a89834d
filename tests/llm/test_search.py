"""Decontamination, whitening and ranked search on small tables, against plain Python."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from claimweave.llm import decontaminate, ranked_search, whitening


def plain_words(text):
    """(word, start, end) of a text, by code points."""
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))]


def plain_hits(text, items, size):
    words = [w for w, _, _ in plain_words(text)]
    hit, of = set(), set()
    for item, body in items:
        own = [w for w, _, _ in plain_words(body)]
        for n in {min(size, len(own))} - {0}:
            for k in range(len(own) - n + 1):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == own[k : k + n]:
                        hit |= set(range(at, at + n))
                        of |= {item} - {None}
    return len(words), hit, sorted(map(str, of))


def odd_texts(r, passages):
    """Texts of few words with passages inside, other cases and marks between them, letters outside ASCII, and odd ones."""
    loose = lambda words: "".join(w.upper() + r.choice([" ", "\n", ", ", "-", "_\x7f", "@"]) if r.random() < 0.3 else w + r.choice([" ", "  ", ". "]) for w in words)
    made = [loose([*(r.choice("a b c ä d1 ж".split()) for _ in range(r.randint(0, 30))), *(r.choice(passages).split() if r.random() < 0.7 else []), *(r.choice("a b c ä".split()) for _ in range(r.randint(0, 9)))]) for _ in range(60)]
    return [*made, None, "", " \n-", "É é", "x" * 5000, "a b a b"]


@pytest.mark.parametrize("most_pairs", [100_000, 7])
def test_hits_equal_search_by_hand(spark, most_pairs):
    r = random.Random(11)
    passages = [" ".join(r.choice("a b c ä d1 ж e".split()) for _ in range(n)) for n in (3, 4, 6, 9, 2, 1)]
    items = [(k, p) for k, p in enumerate(passages)] + [(0, passages[2]), (7, passages[1]), (8, None), (9, " - "), (None, passages[3]), (10, "zz")]
    docs = list(enumerate(odd_texts(r, passages))) + [(None, passages[0]), (None, passages[0]), (3, "other " + passages[1])]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, mark int").repartition(3)
    got = decontaminate.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), size=4, most_pairs=most_pairs).collect()
    key = lambda i, n, hit, of: (-1 if i is None else i, n, tuple(sorted(hit)), tuple(of))
    assert all(x.n_hit == sum(s.last - s.first + 1 for s in x.spans) for x in got)
    assert sorted(key(x.doc_id, x.n_words, {k for s in x.spans for k in range(s.first, s.last + 1)}, x["items"]) for x in got) == sorted(key(i, *plain_hits(t, items, 4)) for i, t in docs)
    texts = dict(docs[:-3])
    for x in got:
        if x.doc_id is not None and x.doc_id != 3:
            words = plain_words(texts[x.doc_id])
            assert all((s.start, s.end) == (words[s.first][1], words[s.last][2]) for s in x.spans)


def test_contamination_of_empty_and_very_long_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c"), (2, " ".join(f"w{k % 977}" for k in range(300_000)) + " x y z")], "doc_id long, text string"), spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), items).isEmpty()
    assert [(x.n_words, x.n_hit, x["items"]) for x in decontaminate.contamination(docs, items.limit(0)).orderBy("doc_id").collect()] == [(3, 0, []), (300_003, 0, [])]
    assert [(x.n_hit, [tuple(s) for s in x.spans][:1]) for x in decontaminate.contamination(docs, items).where("n_hit > 0").select("n_hit", "spans").collect()][0][0] == 3


def plain_search(docs, items, most):
    words = [(i, [w for w, _, _ in plain_words(t)]) for i, t in docs]
    total, terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    holds = Counter(x for _, w in words for x in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(w for w, _, _ in plain_words(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, w in words:
            times, m = Counter(w), 10 + 90 * len(w) * total // max(terms, 1)
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * holds[x] + 1))) * (10**9 * times[x] // (1000 * times[x] + 8 * m)) for x in own if x in times)
            scored += [(-score, i is None, i)] if score else []
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:most], 1)]
    return out


@pytest.mark.parametrize("most_pairs", [200_000, 5])
def test_ranks_equal_scores_by_hand(spark, most_pairs, monkeypatch):
    r = random.Random(13)
    monkeypatch.setattr(ranked_search, "MATCHES", 40)
    docs = list(enumerate(odd_texts(r, ["a b zz", "q c", "ä yy yy"]))) + [(100 + k, "copy of yy zz") for k in range(20)] + [(None, "zz zz yy"), (None, "zz zz yy"), (7, "zz a")]
    items = [(1, "A b, zz"), (2, "YY"), (2, "c"), (3, None), (4, "--"), (5, "unseen"), (None, "ä yy"), (6, "d1 ж a b c")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item long").repartition(5)
    got = ranked_search.search(frame, spark.createDataFrame(items, "item_id long, text string"), most=6, most_pairs=most_pairs).collect()
    order = lambda rows: sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert order(tuple(x) for x in got) == order(plain_search(docs, items, 6))


def test_search_of_empty_tables_and_named_items(spark):
    docs, items = spark.createDataFrame([(1, "a b c"), (2, "a " * 100_000)], "doc_id long, text string"), spark.createDataFrame([("x", "a"), ("y", "b c")], "item_id string, text string")
    assert ranked_search.search(docs.limit(0), items).isEmpty() and ranked_search.search(docs, items.limit(0)).isEmpty()
    assert sorted((x.item_id, x.rank, x.doc_id) for x in ranked_search.search(docs, items).collect()) == [("x", 1, 2), ("x", 2, 1), ("y", 1, 1)]


def test_radix_order_is_stable_and_ties_go_to_the_least_ids():
    r = np.random.default_rng(3)
    for high in (3, 1 << 17, 1 << 40, (1 << 63) - 1):
        keys = r.integers(0, high, 5000).astype(np.uint64)
        assert (ranked_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    scores, ids = np.array([5, 9, 5, 5, 7]), np.array([4, 8, 2, 3, 1])
    assert sorted(ids[ranked_search.best(scores, ids, 4)]) == [1, 2, 3, 8]


def exact_covariance(x):
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(col), n) for col in zip(*x, strict=True)]
    return [[sum((row[i] - mean[i]) * (row[j] - mean[j]) for row in x) / n for j in range(d)] for i in range(d)]


def test_products_keep_what_doubles_lose():
    """Covariances of large, nearly equal numbers: compensated sums give all digits, plain ones don't."""
    r = random.Random(5)
    x = [[2**37 + r.randint(0, 3), -(2**37) + r.randint(0, 1), r.randint(-5, 5)] for _ in range(300)]
    want = exact_covariance(x)
    mean = [Fraction(sum(col), 300) for col in zip(*x, strict=True)]
    high = np.array([float(m) for m in mean])
    low = np.array([float(m - Fraction(float(m))) for m in mean])
    parts = [whitening.products(*whitening.less_mean(np.array(x[a : a + 100], np.float64), high, low)) for a in (0, 100, 200)]
    h, e = whitening.add(whitening.add(parts[0], parts[1]), parts[2])
    for k, (i, j) in enumerate(zip(*np.triu_indices(3), strict=True)):
        assert abs((Fraction(h[k]) + Fraction(e[k])) / 300 - want[i][j]) <= abs(want[i][j]) * Fraction(1, 10**25) + Fraction(1, 10**22)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n int")


def test_whitening_equals_exact_covariance(spark):
    r = random.Random(12)
    mixed = lambda: (lambda a, b, c: [a, a + 0.3 * b, b - c, 2 * c, 0.1 * a + c])(r.gauss(0, 2), r.gauss(0, 1), r.gauss(1, 1))
    rows = [(k, mixed(), "x", 1) for k in range(200)]
    rows += [(None, rows[0][1], "x", 1), (7, rows[1][1], "x", 1)]
    odd = [(300, None, "x", 1), (301, [1.0, None, 1.0, 1.0, 1.0], "x", 1), (302, [float("nan")] * 5, "x", 1), (303, [float("inf")] * 5, "x", 1), (304, [], "x", 1), (305, [1.0, 2.0], "x", 1), (306, [1e300] * 5, "x", 1)]
    got = whitening.whiten(vectors(spark, rows + odd).repartition(4), components=4).collect()
    assert len(got) == 4 * len(rows) and {x.vec_id for x in got} == {k[0] for k in rows}
    x = [[math.floor(64 * c) + 1_000_000 for c in row[1]] for row in rows]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    covariance = np.array([[float(v) for v in row] for row in exact_covariance(x)])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    centred = np.array([[float(c - Fraction(s, n)) for c, s in zip(row, sums, strict=True)] for row in x])
    want = centred @ axes[:, :4] / np.sqrt(values[:4])
    by_row = {}
    for g in got:
        by_row.setdefault((g.vec_id, int(g.deviation)), {}).setdefault(g.component, set()).add((g.whitened, g.explained, g.identity_error, g.n))
    for c in range(1, 5):
        signs = set()
        for k, row in enumerate(rows):
            deviation = sum((n * a - s) ** 2 for a, s in zip(x[k], sums, strict=True))
            ((w, explained, error, count),) = by_row[row[0], deviation][c]
            assert count == n and abs(abs(w) - abs(want[k][c - 1])) < 1e-9 and abs(explained / (values[c - 1] / values.sum()) - 1) < 1e-9 and error < 1e-10
            signs.add(w * want[k][c - 1] > 0)
        assert len(signs) == 1


def test_whitening_without_spread_or_rows(spark):
    assert whitening.whiten(vectors(spark, []).limit(0)).isEmpty() and whitening.whiten(vectors(spark, [(1, None, "x", 1), (2, [], "x", 1)])).isEmpty()
    assert [(x.component, x.n, int(x.deviation), x.whitened, x.explained, x.identity_error) for x in whitening.whiten(vectors(spark, [(1, [0.5, 2.0], "x", 1)])).collect()] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(vectors(spark, [(k, [float(k), 3.0], "x", 1) for k in range(10)])).collect()
    assert {x.component: (x.whitened is None, x.explained) for x in flat} == {1: (False, 1.0), 2: (True, 0.0)} and all(x.identity_error < 1e-12 for x in flat)
    wide = whitening.whiten(vectors(spark, [(k, [2.0**31, -(2.0**31)][:: 1 if k % 2 else -1], "x", 1) for k in range(4)])).collect()
    assert {int(x.deviation) for x in wide} == {2 * (4 * 64 * 2**31) ** 2}


def test_many_tasks_merge_to_the_same(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGED", 2)
    r = random.Random(4)
    rows = vectors(spark, [(k, [r.random() for _ in range(6)], "x", 1) for k in range(90)])
    one, many = (sorted((x.vec_id, x.component, round(x.whitened, 10)) for x in whitening.whiten(rows.repartition(p)).collect()) for p in (1, 9))
    assert one == many
