"""Comparing claims: pairs within a block of subject and measure, and a verdict with its derivation for each pair.

Each pair is decided by one chain of conditions over the pair's columns. The order of the conditions is the order of
the checks: what the claims are about is settled before their values are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import blocks, periods, scope
from claimweave.functions.schema import STEP
from claimweave.functions.text import bag, display_general, display_number, normalise_scope, normalise_subject, similarity, similarity_of_sets, trigrams
from claimweave.sources.store import bounded, checkpointed

VALUE_TOLERANCE, SUBJECT_SIMILARITY, TEXT_AGREEMENT, BLOCK_CAP = 0.01, 0.6, 0.8, 400
#: Claims of a block in a row or column of its grid.
CELL = 1000
#: Parts of measure names that don't add up over parts of a period; found anywhere in a name, so also in "operations".
NOT_ADDITIVE = ("margin", "rate", "growth", "ratio", "per cent", "share")
STATES = ("text", "boolean", "date")
NUMERIC = ("number", "range")
#: Periods' and scopes' relations as numbers, in the order of their names.
EQUALS, CONTAINS, DURING, BEFORE, AFTER, OVERLAPS = range(6)
SAME, SUBSUMES, SUBSUMED_BY, DISJOINT, UNKNOWN = range(5)


def negative_measures(claims: DataFrame) -> DataFrame:
    """(measure_key) of measures with a value below zero anywhere, whatever the claim's status."""
    return claims.where("measure_key <> '' and canonical_low < 0").select("measure_key").distinct()


def compared(claims: DataFrame, negative: DataFrame | None = None) -> DataFrame:
    """Active claims with all that a comparison takes from one side alone, so that pairs only compare it.

    That is the key of the block, normalised scope, basis and text with the text's trigrams and words, and whether the
    measure adds up, is provisional, or is among those (measure_key) that go negative; what kind of value it is, its
    unit and its qualifiers as one text each to compare by, and value and period as a relation shows them.
    """
    row = ("doc_id", "page_no", "period_label", "scope", "basis", "estimate_type")
    kind, dated = F.col("value_kind"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    own = claims.where("status = 'active'").withColumns({
        "kind": F.when(kind.isin(*NUMERIC), 1).when(kind == "date", 2).when(kind == "boolean", 3).when(kind == "text", 4).otherwise(0),
        "has_quantity": F.col("low").isNotNull() | F.col("unit_raw").isNotNull() & F.coalesce(kind.isin(*NUMERIC), F.lit(False)), "has_scale": F.col("canonical_low").isNotNull() & F.col("canonical_high").isNotNull(),
        "unit_key": F.to_json(F.struct("dimension", F.coalesce("currency", F.lit("")).alias("currency"))), "row_key": F.to_json(F.struct(*row)), "shown": display_value(""),
        "dated": F.concat("period_label", F.lit(" ["), dated("period_start"), F.lit(".."), dated("period_end"), F.lit("]")),
        "block_subject": blocks.block_subject(), "block_measure": blocks.block_measure(),
        "scope_norm": normalise_scope(F.col("scope")), "basis_norm": scope.normalise_basis(F.col("basis")), "text_norm": F.when(F.col("text_value").isNotNull(), normalise_subject(F.col("text_value"))),
        "additive": _additive(), "provisional": scope.provisional(F.col("estimate_type")),
    }).withColumns({"scope_class": scope.scope_class(F.col("scope_norm")), "text_grams": F.when(F.col("text_norm") != "", trigrams(F.col("text_norm"))), "text_words": F.when(F.col("text_norm") != "", bag(F.col("text_norm")))})
    if negative is None:
        return own.withColumn("goes_negative", F.lit(False))
    known = bounded(negative.select("measure_key").distinct()).withColumn("goes_negative", F.lit(True))
    return own.join(known, "measure_key", "left").withColumn("goes_negative", F.coalesce("goes_negative", F.lit(False)))


def with_blocks(claims: DataFrame) -> DataFrame:
    """Active claims with their block; a measure goes negative if any claim on it is below zero."""
    return compared(claims, negative_measures(claims))


def capped(blocked: DataFrame, cap: int | None = BLOCK_CAP) -> DataFrame:
    """The cap most confident claims of each block, ties by id: a block's pairs stay bounded. None: all claims."""
    if cap is None:
        return blocked
    order = Window.partitionBy("block_subject", "block_measure").orderBy(F.desc("confidence"), "id")
    return blocked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap).drop("_rank")


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)) for side, df in (("a", left), ("b", right)))


def _met(left: DataFrame, right: DataFrame, cells: DataFrame | None) -> DataFrame:
    """Blocked claims of left and right that share a block, as a_ and b_ columns.

    cells: (block_subject, block_measure, rows, columns) of blocks that are cut into a grid: left's claims are dealt to
    rows, right's to columns, and each cell is a key of its own, so that a hot block's pairs spread over tasks and each
    pair meets in one cell. None: all blocks are small.
    """
    keys = ["block_subject", "block_measure"]
    if cells is not None:
        part = lambda of: F.pmod(F.xxhash64("id"), F.coalesce(of, F.lit(1))).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.coalesce(of, F.lit(1)) - 1))
        left = left.join(cells, keys, "left").withColumn("_i", part("rows")).withColumn("_j", every("columns")).drop("rows", "columns")
        right = right.join(cells, keys, "left").withColumn("_j", part("columns")).withColumn("_i", every("rows")).drop("rows", "columns")
        keys += ["_i", "_j"]
    a, b = _sides(left, right)
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return a.join(b, on).drop("a__i", "a__j", "b__i", "b__j")


def _grid(left: DataFrame, right: DataFrame) -> DataFrame | None:
    """The grids of blocks that have more than CELL claims on a side; None if there is no such block."""
    keys = ("block_subject", "block_measure")
    many = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    large = many(left, "rows").join(many(right, "columns"), list(keys)).where("rows > 1 or columns > 1")
    large = bounded(large)  # as many as all claims over CELL
    return None if large.isEmpty() else large


def block_pairs(blocked: DataFrame, cap: int | None = None) -> DataFrame:
    """Each pair of different claims of one block once, the one with the lesser id as a; cap: what no block has more claims than."""
    cells = None if cap is not None and cap <= CELL else _grid(blocked, blocked)
    return _met(blocked, blocked, cells).where(F.col("a_id") < F.col("b_id"))


def incremental_pairs(new: DataFrame, old: DataFrame, seen: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Pairs of blocked claims that hold a new one, without those in seen (claim_a_id, claim_b_id) either way round."""
    cells = None if cap is not None and cap <= CELL else _grid(new, old)
    across = _met(new, old, cells).where(F.col("a_id") != F.col("b_id"))
    turned = across.select(*(F.when(F.col("a_id") < F.col("b_id"), F.col(f"{s}_{c}")).otherwise(F.col(f"{t}_{c}")).alias(f"{s}_{c}") for s, t in ("ab", "ba") for c in new.columns))
    pairs = turned.unionByName(block_pairs(new, cap))
    if seen is None:
        return pairs
    known = seen.select(F.least("claim_a_id", "claim_b_id").alias("a_id"), F.greatest("claim_a_id", "claim_b_id").alias("b_id")).distinct()
    return pairs.join(known, ["a_id", "b_id"], "left_anti")


def display_value(side: str) -> Column:
    """A claim's value as text, with its unit; side: a or b of a pair, or nothing for a claim."""
    c = lambda name: F.col(f"{side}_{name}" if side else name)
    kind = lambda *kinds: F.coalesce(c("value_kind").isin(*kinds), F.lit(False))
    number = F.when(c("low") == c("high"), display_number(c("low"))).otherwise(F.concat(display_general(c("low")), F.lit(" to "), display_general(c("high"))))
    value = F.when(kind("date"), c("date_value").cast("string")).when(kind("boolean"), c("bool_value").cast("string")).when(c("low").isNotNull(), number).otherwise(c("text_value"))
    return F.concat_ws(" ", F.coalesce(value, F.lit("?")), F.when(kind(*NUMERIC), c("unit_raw")))


def relative_gap() -> Column:
    """The distance of the canonical intervals over the largest bound; 0 if they overlap."""
    al, ah, bl, bh = (F.col(c) for c in ("a_canonical_low", "a_canonical_high", "b_canonical_low", "b_canonical_high"))
    gap = F.least(F.abs(al - bh), F.abs(ah - bl))
    most = F.greatest(F.abs(al), F.abs(ah), F.abs(bl), F.abs(bh), F.lit(1e-9))
    return F.when((al <= bh) & (bl <= ah), 0.0).otherwise(gap / most)


def _both(kind: int) -> Column:
    return (F.col("a_kind") == kind) & (F.col("b_kind") == kind)


def agreement(tolerance: float = VALUE_TOLERANCE) -> Column:
    """Whether the values agree; null if they can't be compared. Dates and truth values that are both missing agree."""
    text = lambda side: tuple(F.col(f"{side}_text_{x}") for x in ("norm", "grams", "words"))
    alike = similarity_of_sets(text("a"), text("b")) >= TEXT_AGREEMENT
    return (
        F.when(_both(1), F.when(F.col("a_has_scale") & F.col("b_has_scale"), relative_gap() <= tolerance))
        .when(_both(2), F.col("a_date_value").eqNullSafe(F.col("b_date_value")))
        .when(_both(3), F.col("a_bool_value").eqNullSafe(F.col("b_bool_value")))
        .when((F.col("a_text_norm") != "") & (F.col("b_text_norm") != ""), alike)
    )


def _additive() -> Column:
    name = F.lower(F.coalesce(F.col("measure_raw"), F.lit("")))
    named = F.lit(False)
    for word in NOT_ADDITIVE:
        named = named | F.contains(name, F.lit(word))
    return F.coalesce(~F.col("dimension").isin("percent", "ratio"), F.lit(False)) & ~named


def containment(a_is_outer: Column) -> Column:
    """fail if a part exceeds the whole, pass if not, info if the values don't add up."""
    pick = lambda name, outer: F.when(a_is_outer == outer, F.col(f"a_{name}")).otherwise(F.col(f"b_{name}"))
    part, whole = pick("canonical_low", F.lit(False)), pick("canonical_high", F.lit(True))
    checked = F.col("a_additive") & F.col("b_additive") & ~pick("goes_negative", F.lit(True)) & F.col("a_has_scale") & F.col("b_has_scale")
    return F.when(~checked, "info").when((part > whole) & (whole > 0), "fail").otherwise("pass")


def _later() -> Column:
    """a or b if that is a later observation of something that changes, else null."""
    a, b = F.col("a_as_of"), F.col("b_as_of")
    later = F.when(a > b, "a").when(b > a, "b")
    state = F.when(later == "a", F.col("a_kind") > 1).otherwise(F.col("b_kind") > 1)
    return F.when(F.col("a_provisional") | F.col("b_provisional") | state, later)


def _fact(name: str) -> Column:
    return F.col(f"_{name}")


# (name, condition, verdict, confidence, summary); the first that holds decides.
def _rules() -> list[tuple]:
    f = _fact
    span, fails, agree = ~f("state"), f("containment") == "fail", f("agree")
    inside, nested = f("period").isin(CONTAINS, DURING), f("scope").isin(SUBSUMES, SUBSUMED_BY)
    quantities, cross = F.col("a_has_quantity") & F.col("b_has_quantity"), f("cross_doc")
    return [
        ("unit", quantities & ~f("canonical"), "underspecified", 0.4, "A unit isn't recognised, so the figures have no common scale."),
        ("unit", quantities & ~f("same_unit"), "underspecified", 0.4, "The units measure different things; currencies are never converted."),
        ("period", F.col("a_period_label").isNull() | F.col("b_period_label").isNull(), "underspecified", 0.45, "A claim doesn't state its period."),
        ("period", f("period").isNull(), "underspecified", 0.45, "A stated period has no dates."),
        ("kinds", agree.isNull(), "underspecified", 0.4, "The claims hold different kinds of values."),
        ("apart", span & f("period").isin(BEFORE, AFTER), "complementary", 0.9, "The periods don't overlap, so both figures can hold."),
        ("partly", span & (f("period") == OVERLAPS), "complementary", 0.8, "The periods overlap in part, so the figures cover different spans."),
        ("inside", span & inside & fails, "contradicts", 0.85, "The figure for a part of the period exceeds that for the whole of it."),
        ("inside", span & inside, "complementary", 0.9, "One period lies inside the other: a part of the total."),
        ("nested", nested & fails, "contradicts", 0.8, "The figure of the narrower scope exceeds that of the wider one."),
        ("nested", nested, "complementary", 0.88, "One scope is a part of the other."),
        ("segments", f("scope") == DISJOINT, "complementary", 0.85, "The scopes are separate parts."),
        ("scope", f("scope") == UNKNOWN, "underspecified", 0.5, "It isn't clear whether the scopes are the same."),
        ("basis", f("basis") == "different", "complementary", 0.85, "The figures are on different bases."),
        ("basis unknown", f("basis") == "unknown", "underspecified", 0.45, "It isn't clear whether the bases are the same."),
        ("rows", ~agree & (F.col("a_row_key") == F.col("b_row_key")), "underspecified", 0.5, "Both figures come from one page with the same qualifiers, so the measure's name is too coarse."),
        ("agree", agree & cross, "corroborates", 0.9, "Two documents state the same for the same measure, period and scope."),
        ("agree", agree, "corroborates", 0.75, "The document states the same twice."),
        ("later", f("later").isNotNull(), "supersedes", 0.85, "The later observation replaces the earlier one."),
        ("differ", F.lit(True), "contradicts", 0.85, "Measure, period, scope and basis are the same, but the values differ beyond rounding."),
    ]


def judged(pairs: DataFrame, tolerance: float = VALUE_TOLERANCE) -> DataFrame:
    """Pairs with what their verdict depends on, each computed once, and the number of the rule that decides.

    Pairs of unlike subjects (similarity below 0.6) are left out. Text similarity is computed for pairs of texts alone.
    The rule's number is made by a generator of one row, below which Spark moves no filter: a condition on it would
    otherwise be evaluated as the whole tree of what it depends on, in the join and once more for each time it's named.
    """
    period = lambda side: F.struct(F.col(f"{side}_period_start").alias("start"), F.col(f"{side}_period_end").alias("end"))
    subjects = F.when(F.col("a_block_subject") == F.col("b_block_subject"), 1.0).otherwise(similarity(F.col("a_block_subject"), F.col("b_block_subject")))
    norm = lambda name: (F.col(f"a_{name}"), F.col(f"b_{name}"))
    facts = {
        "canonical": F.col("a_has_scale") & F.col("b_has_scale"), "same_unit": F.col("a_unit_key") == F.col("b_unit_key"), "period": periods.relate(period("a"), period("b"), range(6)),
        "state": (F.col("a_kind") > 1) & (F.col("b_kind") > 1), "scope": scope.relate_classed_scopes(*norm("scope_norm"), *norm("scope_class"), range(5)),
        "basis": scope.relate_normal_bases(*norm("basis_norm")), "agree": agreement(tolerance), "later": _later(), "cross_doc": ~F.col("a_doc_id").eqNullSafe(F.col("b_doc_id")),
    }
    with_facts = pairs.where(subjects >= SUBJECT_SIMILARITY).select("*", *(v.alias(f"_{k}") for k, v in facts.items()))
    outer_a = F.when(_fact("period").isin(CONTAINS, DURING) & ~_fact("state"), _fact("period") == CONTAINS).otherwise(_fact("scope") == SUBSUMES)
    with_facts = with_facts.withColumn("_outer_a", outer_a)
    with_facts = with_facts.withColumn("_containment", containment(_fact("outer_a")))
    number = _first_of([(r[1], F.lit(k)) for k, r in enumerate(_rules())])
    return with_facts.select("*", F.explode(F.array(number)).alias("_number"))


def _named(*names: str) -> Column:
    """One of the rules of these names decided."""
    return _fact("number").isin(*(k for k, r in enumerate(_rules()) if r[0] in names))


def _steps() -> list[tuple[str, Column, Column]]:
    """The derivation of a judged pair: (check, outcome, detail), the outcome null where the check isn't reached."""
    f = _fact
    a, b = (lambda name, side=side: F.col(f"{side}_{name}") for side in "ab")
    lit = F.lit
    quoted = lambda name: F.concat(lit("'"), F.coalesce(a(name), lit("unstated")), lit("' and '"), F.coalesce(b(name), lit("unstated")), lit("'"))
    named = lambda names, code: F.get(F.array(*(lit(n) for n in names)), code)
    shown = F.concat(a("shown"), lit(" vs "), b("shown"))
    unit_ok = f("canonical") & f("same_unit")
    after_unit, after_period = ~_named("unit"), ~_named("unit", "period")
    value = F.when(_named("kinds"), "blocked").when(_named("apart", "partly", "basis"), "info").when(_named("rows", "agree", "later", "differ"), F.when(f("agree"), "pass").otherwise("fail"))
    return [
        ("subject", lit("pass"), quoted("subject_raw")),
        ("measure", lit("pass"), F.concat(quoted("measure_raw"), lit(" as "), F.coalesce(a("block_measure"), lit("?")))),
        ("unit", F.when(a("has_quantity") & b("has_quantity"), F.when(unit_ok, "pass").otherwise("blocked")), F.concat(quoted("unit_raw"), F.when(unit_ok, F.concat(lit(" measure "), F.coalesce(a("dimension"), lit("?")))).when(~f("canonical"), " have no common scale").otherwise(" measure different things"))),
        ("period", F.when(after_unit, F.when(_named("period"), "blocked").when(f("period") == EQUALS, "pass").otherwise("info")), F.concat_ws(" ", F.coalesce(a("dated"), lit("unstated")), F.coalesce(named(periods.RELATIONS, f("period")), lit("?")), F.coalesce(b("dated"), lit("unstated")))),
        ("period: state", F.when(after_period & f("state") & (f("period") != EQUALS), "info"), lit("a state holds until it changes: the period says when it was observed")),
        ("scope", F.when(after_period, F.when(f("scope") == SAME, "pass").otherwise("info")), F.concat(quoted("scope"), lit(": "), named(scope.RELATIONS, f("scope")))),
        ("basis", F.when(after_period, F.when(f("basis") == "same", "pass").when(f("basis") == "different", "info").otherwise("blocked")), scope.basis_detail(a("basis_norm"), b("basis_norm"))),
        ("value", value, F.when(_named("kinds"), "the values are of different kinds").otherwise(shown)),
        ("period-containment", F.when(_named("inside"), f("containment")), shown),
        ("scope-containment", F.when(_named("nested"), f("containment")), shown),
        ("provenance", F.when(_named("rows"), "blocked"), F.concat(lit("both from page "), a("page_no").cast("string"), lit(" of "), a("doc_id"))),
        ("as_of", F.when(_named("later"), "info"), F.concat(F.greatest(a("as_of"), b("as_of")).cast("string"), lit(" is later than "), F.least(a("as_of"), b("as_of")).cast("string"))),
    ]


def _of_rule(i: int) -> Column:
    return F.get(F.array(*(F.lit(r[i]) for r in _rules())), _fact("number"))


def _identified() -> list[Column]:
    return [F.substring(F.sha2(F.concat_ws("|", "a_id", "b_id"), 256), 1, 16).alias("id"), F.col("a_id").alias("claim_a_id"), F.col("b_id").alias("claim_b_id"), _of_rule(2).alias("verdict"), _of_rule(3).cast("double").alias("confidence")]


def verdicts(pairs: DataFrame, tolerance: float = VALUE_TOLERANCE) -> DataFrame:
    """Relations of pairs: (id, claim_a_id, claim_b_id, verdict, confidence, summary, trace, cross_doc).

    Pairs of unlike subjects (similarity below 0.6) give no relation. Nothing is dropped for lack of qualifiers: such
    pairs are underspecified.
    """
    return told(judged(pairs, tolerance))


def told(decided: DataFrame) -> DataFrame:
    """The relations of judged pairs, with their summaries and traces."""
    note = F.when(_named("differ") & (F.col("a_as_of") != F.col("b_as_of")), " The documents carry different dates, so this may be a restatement.").otherwise("")
    none = F.array().cast(f"array<{STEP}>")  # a lambda over the steps, as array_compact has, would have Spark interpret them all
    step = lambda check, outcome, detail: F.when(outcome.isNotNull(), F.array(F.struct(F.lit(check.partition(":")[0]).alias("check"), outcome.alias("outcome"), detail.alias("detail")).cast(STEP))).otherwise(none)
    trace = F.flatten(F.array(*(step(*x) for x in _steps())))
    return decided.select(*_identified(), F.concat(_of_rule(4), note).alias("summary"), trace.alias("trace"), _fact("cross_doc").alias("cross_doc"))


def outlines(decided: DataFrame) -> DataFrame:
    """The relations of judged pairs with their checks' outcomes in place of summary and trace, which cost most of the time.

    outcomes has a field for each check, null where it isn't reached; only fields that are used are computed.
    """
    outcomes = F.struct(*(outcome.alias(check) for check, outcome, _ in _steps()))
    return decided.select(*_identified(), _fact("cross_doc").alias("cross_doc"), outcomes.alias("outcomes"))


def _first_of(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out


def judged_pairs(claims: DataFrame, cap: int | None = BLOCK_CAP, tolerance: float = VALUE_TOLERANCE) -> DataFrame:
    """All pairs of active claims that share a block, judged."""
    return judged(block_pairs(capped(with_blocks(claims), cap), cap), tolerance)


def reconcile(claims: DataFrame, cap: int | None = BLOCK_CAP, tolerance: float = VALUE_TOLERANCE) -> DataFrame:
    """Relations of all pairs of active claims that share a block."""
    return told(judged_pairs(claims, cap, tolerance))


def outlined(claims: DataFrame, cap: int | None = BLOCK_CAP, tolerance: float = VALUE_TOLERANCE) -> DataFrame:
    """The same without summaries and traces, to choose from: in_full() tells those that were chosen."""
    return outlines(judged_pairs(claims, cap, tolerance))


def in_full(found: DataFrame, claims: DataFrame, tolerance: float = VALUE_TOLERANCE) -> DataFrame:
    """The relations of the pairs (claim_a_id, claim_b_id) in found, of which there are few, with summaries and traces."""
    few = bounded(found.select("claim_a_id", "claim_b_id").distinct())
    ids = bounded(few.select(F.explode(F.array("claim_a_id", "claim_b_id")).alias("id")).distinct())
    own = compared(claims.join(ids, "id", "left_semi"), negative_measures(claims))
    a, b = _sides(own, own)
    return verdicts(few.join(a, F.col("claim_a_id") == F.col("a_id")).join(b, F.col("claim_b_id") == F.col("b_id")), tolerance)


def reconcile_incremental(new: DataFrame, old: DataFrame, seen: DataFrame | None = None, tolerance: float = VALUE_TOLERANCE, cap: int | None = None) -> DataFrame:
    """Relations of the pairs that new claims add: with old ones and among themselves, without pairs that were seen.

    A measure that new claims show to go negative counts as such here, but pairs that were seen aren't looked at again:
    follow() does that. cap bounds the blocks as in reconcile(); by itself all pairs of a block are compared. Of the old
    claims only those of new ones' blocks are prepared, once; they aren't shuffled where the new blocks can be broadcast.
    """
    negative = negative_measures(new).union(negative_measures(old)).distinct()
    block = {"_subject": blocks.block_subject(), "_measure": blocks.block_measure()}
    own = bounded(new.where("status = 'active'").withColumns(block).select(*block).distinct())
    met = old.withColumns(block).join(own, list(block), "left_semi").drop(*block)
    both = new.withColumn("_new", F.lit(True)).unionByName(met.withColumn("_new", F.lit(False)))
    both = checkpointed(capped(compared(both, negative), cap))
    return verdicts(incremental_pairs(both.where("_new").drop("_new"), both.where("not _new").drop("_new"), seen, cap), tolerance)


#: What a verdict depends on, besides whether the measure goes negative.
STATE = (
    "doc_id", "page_no", "subject_raw", "measure_raw", "value_kind", "low", "high", "unit_raw", "dimension", "currency", "canonical_low", "canonical_high", "text_value", "date_value", "bool_value",
    "period_label", "period_start", "period_end", "scope", "basis", "as_of", "estimate_type", "block_subject", "block_measure",
)


def follow(before: DataFrame, after: DataFrame, negative_before: DataFrame, negative_after: DataFrame, cap: int | None = BLOCK_CAP, tolerance: float = VALUE_TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """What a change of whole blocks does to their relations: (those made, pairs (claim_a_id, claim_b_id) that have none any more).

    before and after hold all claims of the blocks, with the measures (measure_key) that go negative then and now. A
    claim has changed if it came or went, also by the cap, or if anything differs that verdicts depend on; pairs of two
    claims that haven't keep their relation. So do those of claims whose measure turned negative, or no longer is, and
    nothing else, unless parts of a whole are compared. A pair has no relation any more if its claims have no common
    block now. Neither frame holds a pair twice; what is made is computed when it is read.
    """
    then, now = (checkpointed(capped(compared(df, negative), cap)) for df, negative in ((before, negative_before), (after, negative_after)))
    state = lambda df: df.select("id", "goes_negative", F.md5(F.to_json(F.struct(*STATE))).alias("state"))
    both = state(then).union(state(now)).groupBy("id").agg(F.count("*").alias("n"), F.min("state").alias("lo"), F.max("state").alias("hi"), F.min("goes_negative").alias("never"), F.max("goes_negative").alias("ever"))
    changed = bounded(both.withColumn("_own", (F.col("n") == 1) | (F.col("lo") != F.col("hi"))).where("_own or never <> ever").select("id", "_own"))
    members = now.join(changed, "id", "left")
    new, old = members.where("_own is not null"), members.where("_own is null").withColumn("_own", F.lit(False))
    decided = judged(incremental_pairs(new, old, None, cap), tolerance).where(F.col("a__own") | F.col("b__own") | _named("inside", "nested"))

    blocks_now = now.select("id", F.struct("block_subject", "block_measure").alias("_now"))
    had = then.select("id", "block_subject", "block_measure").join(blocks_now, "id", "left")
    left = ~F.coalesce(F.col("_now") == F.struct("block_subject", "block_measure"), F.lit(False))
    gone = incremental_pairs(had.where(left), had.where(~left), None, cap).where(~F.coalesce(F.col("a__now") == F.col("b__now"), F.lit(False)))
    return told(decided), gone.select(F.col("a_id").alias("claim_a_id"), F.col("b_id").alias("claim_b_id"))


def reconcile_pair(pair_a: DataFrame, pair_b: DataFrame, negative: DataFrame | None = None) -> DataFrame:
    """Relations of claims paired by a column pair_id, blocks aside: for a pair given by hand."""
    a, b = _sides(compared(pair_a, negative), compared(pair_b, negative))
    return verdicts(a.join(b, (F.col("a_pair_id") == F.col("b_pair_id")) & (F.col("a_id") != F.col("b_id"))))
