"""Scopes and bases: which slice of the subject a claim is about, and under which accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions.text import normalise_scope

# Fixed values.
CONSOLIDATED = ("consolidated", "group", "consolidated basis")
STANDALONE = ("standalone", "separate", "parent", "standalone basis", "company")
TOTAL = ("total", "overall", "aggregate", "all", "whole", "entity", "economy")
MODIFYING_BASIS = ("adjusted", "restated", "normalised", "normalized", "pro forma", "like-for-like")
PROVISIONAL = ("projection", "projected", "forecast", "estimate", "estimated", "provisional", "advance estimate")


def relate_scope(a: Column, b: Column) -> Column:
    """Scope a to scope b: same, subsumes, subsumed_by, disjoint or unknown. An unstated scope is no wildcard."""
    return relate_normal_scopes(normalise_scope(a), normalise_scope(b))


#: How a scope can lie to another one.
RELATIONS = ("same", "subsumes", "subsumed_by", "disjoint", "unknown")
GROUP, OWN, WHOLE, NAMED = range(4)


def scope_class(s: Column) -> Column:
    """The group, the company itself, the whole, or a part that is named; null if it isn't stated."""
    return F.when(s.isin(*CONSOLIDATED), GROUP).when(s.isin(*STANDALONE), OWN).when(s.isin(*TOTAL), WHOLE).when(s.isNotNull(), NAMED)


def relate_normal_scopes(x: Column, y: Column) -> Column:
    """The same for scopes that are normalised already."""
    return relate_classed_scopes(x, y, scope_class(x), scope_class(y))


def relate_classed_scopes(x: Column, y: Column, of_x: Column, of_y: Column, names: Sequence = RELATIONS) -> Column:
    """The same where the classes of both are there already; names: what to call the relations."""
    same, subsumes, subsumed_by, disjoint, unknown = names
    wide = lambda s: s.isin(GROUP, WHOLE)
    return (
        F.when(x.isNull() & y.isNull(), same)
        .when(x.isNull() | y.isNull(), unknown)
        .when(x == y, same)
        .when((of_x == GROUP) & (of_y == OWN) | wide(of_x) & (of_y == NAMED), subsumes)
        .when((of_x == OWN) & (of_y == GROUP) | wide(of_y) & (of_x == NAMED), subsumed_by)
        .when(F.contains(y, x), subsumes)
        .when(F.contains(x, y), subsumed_by)
        .when((of_x == NAMED) & (of_y == NAMED), disjoint)
        .otherwise(unknown)
    )


def relate_basis(a: Column, b: Column) -> Column:
    """same, different, or unknown if one side names a basis that changes figures and the other names none."""
    return relate_normal_bases(normalise_basis(a), normalise_basis(b))


def normalise_basis(basis: Column) -> Column:
    """In lower case and trimmed; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(basis, r"(?U)^\s+|\s+$", "")), F.lit(""))


def relate_normal_bases(x: Column, y: Column) -> Column:
    return F.when(x.eqNullSafe(y), "same").when(x.isNotNull() & y.isNotNull(), "different").when(F.coalesce(x, y).isin(*MODIFYING_BASIS), "unknown").otherwise("same")


def basis_detail(x: Column, y: Column) -> Column:
    """Two normalised bases in words."""
    return F.when(x.eqNullSafe(y), F.concat(F.lit("both "), F.coalesce(x, F.lit("unstated")))).otherwise(F.concat_ws(" vs ", F.coalesce(x, F.lit("unstated")), F.coalesce(y, F.lit("unstated"))))


def provisional(estimate_type: Column) -> Column:
    return F.coalesce(F.lower(estimate_type).isin(*PROVISIONAL), F.lit(False))
