"""The vocabulary of measures: names that mean the same get one key. Similarity proposes pairs; decisions merge them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions.schema import MEASURE
from claimweave.functions.text import bag, normalise_measure, normalise_subject, similarity, trigrams

PROPOSE, AUTO_ACCEPT, CANDIDATES, KEY_LENGTH, BATCH = 0.45, 0.995, 2, 60, 15


def named(names: DataFrame) -> DataFrame:
    """(name, ord) to (norm, name, surface_forms, ord): one row for each normalised name, the first spelling as its name."""
    return names.withColumn("norm", normalise_measure(F.col("name"))).where("norm <> ''").groupBy("norm").agg(F.min_by("name", F.struct("ord", "name")).alias("name"), F.array_sort(F.collect_set("name")).alias("surface_forms"), F.min("ord").alias("ord"))


def _features(names: DataFrame) -> DataFrame:
    """(norm, kind, n, f): each name's distinct trigrams (kind 0) and words (kind 1), with their number."""
    sets = names.select("norm", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), fs.alias("fs")) for k, fs in enumerate((trigrams(F.col("norm")), bag(F.col("norm"))))))).alias("s"))
    return sets.select("norm", "s.kind", F.size("s.fs").alias("n"), F.explode("s.fs").alias("f"))


def _ranked(names: DataFrame, often: DataFrame) -> DataFrame:
    """(norm, kind, n, fs): each name's features, the rarest first, in an order common to all names."""
    return _features(names).join(often, ["kind", "f"]).groupBy("norm", "kind", "n").agg(F.array_sort(F.collect_list(F.struct("often", "f"))).alias("fs"))


def _share(amount: Column) -> Column:
    """How many features that many are at least, as a whole number."""
    return F.ceil(amount - 1e-9)


def alike_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(norm, candidate) of names by _ranked() that may be alike from threshold on, by trigrams or by words.

    Sets of n <= m features with a Jaccard similarity t share at least t / (1 + t) * (n + m) of them, so 2t / (1 + t) * n,
    and t * m. So one of the first n - 2t / (1 + t) * n + 1 of the smaller set is among the first m - t * m + 1 of the
    larger one, and what follows the places where the two first meet must hold the rest. Both are conditions of the
    join: a word that many names of two words have is in no smaller set's start, and makes no rows.
    """
    t = threshold

    def starts(sets: DataFrame, name: str, x: str, share: float) -> DataFrame:
        first = F.col("n") - _share(F.lit(share) * F.col("n")) + 1
        found = sets.select(F.col("norm").alias(name), "kind", F.col("n").alias(f"n_{x}"), F.posexplode(F.slice("fs", F.lit(1), first.cast("int"))).alias(f"at_{x}", "s"))
        return found.select(name, "kind", f"n_{x}", (F.col(f"n_{x}") - F.col(f"at_{x}")).alias(f"left_{x}"), F.col("s.f").alias("f"))

    def met(small: DataFrame, one: str, large: DataFrame, other: str) -> DataFrame:
        a, b = starts(small, one, "a", 2 * t / (1 + t)), starts(large, other, "b", t)
        sizes = (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") >= t * F.col("n_b") - 1e-9)
        enough = F.least("left_a", "left_b") >= _share(F.lit(t / (1 + t)) * (F.col("n_a") + F.col("n_b")))
        return a.join(b, ["kind", "f"]).where(sizes & enough & (F.col(one) != F.col(other))).select("norm", "candidate")

    return met(left, "norm", right, "candidate").union(met(right, "candidate", left, "norm")).distinct()


#: Similarities down to which a name's most alike ones are looked for, one after the other, until there are enough.
LEVELS = (0.75,)


def candidates(names: DataFrame, known: DataFrame, threshold: float = PROPOSE, most: int | None = CANDIDATES, without: DataFrame | None = None) -> DataFrame:
    """(norm) against known (norm): each name's most alike known ones, (norm, candidate, similarity, rank).

    most: so many for each name, ties by name; None keeps all, without a rank. without: pairs (norm, candidate) to leave
    out. Pairs come from equi-joins on the rarest trigrams and words, which lose none from their threshold on. With
    most, names are searched from a high similarity down to threshold, and a name that has found enough is not searched
    again: what it hasn't found is less alike. So of many names that are all alike to some degree, not all pairs are made.
    """
    from claimweave.sources.store import checkpointed

    left, right = names.select("norm").distinct(), known.select("norm").distinct()
    often = _features(left.union(right).distinct()).groupBy("kind", "f").agg(F.count("*").alias("often"))
    sets = checkpointed(_ranked(left.union(right).distinct(), often))
    own, others = sets.join(left, "norm", "left_semi"), sets.join(right, "norm", "left_semi")

    def alike(own: DataFrame, t: float) -> DataFrame:
        pairs = alike_pairs(own, others, t)
        if without is not None:
            pairs = pairs.join(without.select("norm", "candidate"), ["norm", "candidate"], "left_anti")
        return pairs.withColumn("similarity", similarity(F.col("norm"), F.col("candidate"))).where(F.col("similarity") >= t)

    if most is None:
        return alike(own, threshold)
    rank = F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("similarity"), "candidate"))
    found, todo = None, left
    for t in [*(x for x in LEVELS if x > threshold), threshold]:
        best = checkpointed(alike(own.join(todo, "norm", "left_semi"), t).withColumn("rank", rank).where(F.col("rank") <= most))
        enough = best.groupBy("norm").agg(F.count("*").alias("n")).where(F.lit(t == threshold) | (F.col("n") >= most)).select("norm")
        done = best.join(enough, "norm", "left_semi").select("norm", "candidate", "similarity", "rank")
        found = done if found is None else found.unionByName(done)
        if t == threshold:
            break
        todo = checkpointed(todo.join(enough, "norm", "left_anti"))
        if todo.isEmpty():
            break
    return found


def resolve_name(name: str, measures: DataFrame, decisions: DataFrame) -> tuple[str | None, str]:
    """One written name against measures (key, canonical_name, aliases, ...): (key, how it was found).

    exact: it is an alias; similar or adjudicated: one of its two most alike measures is the same by similarity, or by
    a decision; new: none is, and there is no key yet.
    """
    spark = measures.sparkSession
    one = spark.createDataFrame([(name,)], "name string").select(normalise_measure(F.col("name")).alias("norm"))
    known = measures.select("key", normalise_measure(F.col("canonical_name")).alias("canonical"), F.explode("aliases").alias("norm"))
    if hit := known.join(one, "norm").orderBy("key").first():
        return hit["key"], "exact"
    near = candidates(one, known.select("norm"), most=None).join(known.withColumnRenamed("norm", "candidate"), "candidate")
    best = near.groupBy("norm", "key", "canonical").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "key").limit(CANDIDATES)
    said = decisions.select(normalise_measure(F.col("a")).alias("x"), normalise_measure(F.col("b")).alias("y"), "same")
    asked = best.join(said, ((F.col("x") == F.col("norm")) & (F.col("y") == F.col("canonical"))) | ((F.col("y") == F.col("norm")) & (F.col("x") == F.col("canonical"))), "left")
    for row in asked.groupBy("key", "similarity").agg(F.bool_or("same").alias("same")).orderBy(F.desc("similarity"), "key").collect():  # CANDIDATES rows
        if row["similarity"] >= AUTO_ACCEPT:
            return row["key"], "similar"
        if row["same"]:
            return row["key"], "adjudicated"
    return None, "new"


def to_json(measures: DataFrame, decisions: DataFrame) -> DataFrame:
    """(kind, body): a line of JSON for each measure and each decision, to be written as text files."""
    lines = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("body"))
    return lines(measures.select("key", "canonical_name", "aliases", "surface_forms"), "measure").unionByName(lines(decisions.select("a", "b", "same"), "decision"))


def save_json(path: str, measures: DataFrame, decisions: DataFrame) -> None:
    """Write the registry as JSON lines under a folder; what was there is replaced."""
    to_json(measures, decisions).write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(measures, decisions) of a folder that save_json wrote."""
    lines = spark.read.schema("kind string, body string").json(path)
    read = lambda kind, ddl: lines.where(F.col("kind") == kind).select(F.from_json("body", ddl).alias("x")).select("x.*")
    return read("measure", MEASURE), read("decision", "a string, b string, same boolean")


def closure(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) links over nodes (node, ord) to (node, root): the first node that each one reaches.

    Labels spread over links and jump to their label's label, until nothing changes: the rounds are as many as the
    logarithm of the longest chain. The vocabulary is small beside the claims; rounds are cut by checkpoints.
    """
    from claimweave.sources.store import checkpointed

    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    labels = checkpointed(nodes.select("node", F.struct("ord", "node").alias("label")))
    while True:
        least = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(least, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        of = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        new = checkpointed(spread.join(of, F.col("low.node") == F.col("_node")).select("node", F.col("label").alias("old"), F.least("low", "_label").alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels.select("node", F.col("label.node").alias("root"))


def resolve(names: DataFrame, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(name, ord), ord of any type that has an order, and decisions (a, b, same) to (measures, name to key, open questions).

    Names with one normalised form are one measure; so are names that score from 0.995 on, such as the same words in
    another order, and names that decisions call the same, over chains of them. A pair from 0.45 on without a decision
    is a question (norm, candidate, similarity) if it is among the most alike open ones of either of its names; a pair
    that was decided against is none. Missing decisions mean
    "different". Measures' keys are the first spelling's normalised form with underscores, 60 characters at most,
    numbered where two of them clash.
    """
    from claimweave.sources.store import checkpointed

    forms = checkpointed(named(names))
    same = candidates(forms, forms, AUTO_ACCEPT, most=None).select(F.least("norm", "candidate").alias("a"), F.greatest("norm", "candidate").alias("b")).distinct().withColumn("same", F.lit(True))
    decided = checkpointed(same)
    if decisions is not None:
        said = decisions.select(normalise_measure(F.col("a")).alias("x"), normalise_measure(F.col("b")).alias("y"), F.coalesce("same", F.lit(False)).alias("same"))
        said = said.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "same")
        decided = checkpointed(decided.unionByName(said).groupBy("a", "b").agg(F.bool_or("same").alias("same")))
    links = decided.where("same").select("a", "b")
    roots = closure(links, forms.select(F.col("norm").alias("node"), "ord"))
    members = forms.join(roots, F.col("norm") == F.col("node")).drop("node")
    measures = members.groupBy("root").agg(F.min_by("name", "ord").alias("canonical_name"), F.array_sort(F.collect_set("norm")).alias("aliases"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("surface_forms")))).alias("surface_forms"), F.min("ord").alias("ord"))
    short = measures.withColumn("short", F.substring(F.replace("root", F.lit(" "), F.lit("_")), 1, KEY_LENGTH))
    number = F.row_number().over(Window.partitionBy("short").orderBy("ord", "root"))
    keyed = checkpointed(short.withColumn("n", number).withColumn("key", F.when(F.col("n") == 1, F.col("short")).otherwise(F.concat_ws("_", "short", F.col("n").cast("string")))))
    keys = members.join(keyed.select("root", "key"), "root").select(F.explode("surface_forms").alias("name"), "norm", "key")
    closed = decided.select(F.col("a").alias("norm"), F.col("b").alias("candidate")).union(decided.select("b", "a"))
    asked = candidates(forms, forms, without=closed)
    questions = asked.select(F.least("norm", "candidate").alias("norm"), F.greatest("norm", "candidate").alias("candidate"), "similarity").distinct()
    return keyed.select("key", "canonical_name", "aliases", "surface_forms"), keys, questions


PAIRS_PROMPT = (
    "For each numbered pair below, decide whether both names mean the same measured quantity. The same quantity in other words is the same; separate line items of a report, a measure and its rate of change, and a measure and its ratio are different. "
    'When unsure, answer false. Answer with a JSON object: {"decisions": [{"n": 1, "same": true or false}, ...]}, one entry for each pair.\n\n'
)


def adjudicator(provider: Callable[[str], str | None]) -> Callable[[list[tuple[str, str]]], list[bool]]:
    """An answer for adjudicate() that asks a model about a batch of pairs in one prompt. Pairs that its reply leaves out are different."""

    def answer(pairs: list[tuple[str, str]]) -> list[bool]:
        text = provider(PAIRS_PROMPT + "\n".join(f'{i}. A: "{a}"   B: "{b}"' for i, (a, b) in enumerate(pairs, 1))) or ""
        found = json.loads(text[text.index("{") : text.rindex("}") + 1])
        same = {str(d.get("n")): d.get("same") is True for d in found.get("decisions", []) if isinstance(d, dict)}
        return [same.get(str(i), False) for i in range(1, len(pairs) + 1)]

    return answer


def adjudicate(questions: DataFrame, answer, cache: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """Decisions (a, b, same) on questions, from cache where it has them, else by answer, batch pairs at a time.

    answer: a function from a list of (name, candidate) to a list of booleans or None; it runs in the tasks. What it
    leaves out, or fails on, counts as different.
    """
    import pandas as pd

    asked = questions.select(F.col("norm").alias("a"), F.col("candidate").alias("b")).distinct()
    missing = asked if cache is None else asked.join(cache, ["a", "b"], "left_anti")

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                pairs = list(part.itertuples(index=False, name=None))
                try:
                    got = list(answer(pairs))
                except Exception:  # a provider's failure leaves the names apart
                    got = []
                yield pd.DataFrame({"a": part["a"], "b": part["b"], "same": [bool(got[i]) if i < len(got) else False for i in range(len(pairs))]})

    fresh = missing.mapInPandas(run, "a string, b string, same boolean")
    return fresh if cache is None else fresh.unionByName(asked.join(cache, ["a", "b"]).select("a", "b", "same"))


def first_names(claims: DataFrame) -> DataFrame:
    """(name, ord): claims' measure names, by where each occurs first."""
    return claims.groupBy(F.col("measure_raw").alias("name")).agg(F.min(F.struct("doc_id", "page_no", "id")).alias("ord"))


def with_keys(claims: DataFrame, keys: DataFrame) -> DataFrame:
    """Claims with their measure's key by name, and, if they have one, their subject's."""
    found = keys.select(F.col("name").alias("_name"), F.col("key").alias("_key"))
    out = claims.join(found, F.col("measure_raw") == F.col("_name"), "left").withColumn("measure_key", F.col("_key"))
    if "subject_raw" in claims.columns:
        out = out.withColumn("subject_key", normalise_subject(F.col("subject_raw")))
    return out.select(*claims.columns, *(["measure_key"] if "measure_key" not in claims.columns else []))


def canonicalise_claims(claims: DataFrame, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolve claims' measure names once each and write the keys back: (claims, measures, questions)."""
    measures, keys, questions = resolve(first_names(claims), decisions)
    return with_keys(claims, keys), measures, questions
