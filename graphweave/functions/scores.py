"""Scores of findings and proposals as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The properties that the engine itself writes, which take no part in comparisons.
GOVERNANCE = ["_dedupe_key", "_schema_version", "_chunk_id", "_primary_value", "run_id", "schema_version"]
# Risk of a finding's type and of a proposal's class.
TYPE_RISK = {"exact_node_duplicate": "medium", "exact_rel_duplicate": "medium", "probable_duplicate": "high", "canonical_violation": "medium", "structural_anomaly": "low"}
CLASS_RISK = {"merge": "high", "delete": "high", "rename": "medium", "normalize": "medium", "canonicalize": "low", "defer": "low"}
LEVELS = ["low", "medium", "high"]


def own_properties(props: Column) -> Column:
    """Without the engine's properties; null counts as none."""
    return F.map_filter(F.coalesce(props, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(GOVERNANCE))


def property_overlap(a: Column, b: Column) -> Column:
    """Properties with equal trimmed values in both, of all names in either; 0 without any."""
    names = F.array_union(F.map_keys(own_properties(a)), F.map_keys(own_properties(b)))
    same = F.filter(names, lambda k: F.trim(F.element_at(a, k)) == F.trim(F.element_at(b, k)))
    return F.when(F.size(names) == 0, 0.0).otherwise(F.size(same) / F.size(names))


def contradictions(a: Column, b: Column) -> Column:
    """Names, sorted, whose values are not empty in both and differ when trimmed."""
    both = F.array_intersect(F.map_keys(own_properties(a)), F.map_keys(own_properties(b)))
    x, y = (lambda k: F.element_at(a, k)), (lambda k: F.element_at(b, k))
    return F.array_sort(F.filter(both, lambda k: (x(k) != "") & (y(k) != "") & (F.trim(x(k)) != F.trim(y(k)))))


def composite(similarity: Column, overlap: Column, context: Column, contained: Column, properties: Column) -> Column:
    """The weighted score of a pair; the weight of the context goes to the similarity where there is none."""
    with_context = 0.5 * similarity + 0.25 * overlap + 0.15 * context + 0.1 * properties
    without = (0.5 + 0.15) * similarity + 0.25 * overlap + 0.1 * properties
    held = 0.7 + F.least(context * 0.15 + properties * 0.1, F.lit(0.25))
    return F.round(F.when(contained, held).when(context == 0, without).otherwise(with_context), 4)


def band(score: Column, conflicts: Column) -> Column:
    return F.when((score >= 0.8) & (F.size(conflicts) == 0), "high").when(score >= 0.6, "medium").otherwise("low")


def sufficiency(similarity: Column, overlap: Column, context: Column, supporting: Column, corroborating: Column, conflicting: Column) -> Column:
    """How far a finding's own scores and its counted evidence suffice, 1 at most."""
    own = F.when(similarity >= 0.95, 0.5).when(similarity >= 0.9, 0.4).when(similarity >= 0.85, 0.3).otherwise(0.0)
    total = own + F.least(context, F.lit(0.2)) + F.when(overlap >= 0.5, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), total + 0.3 * supporting + 0.15 * corroborating + 0.1 * conflicting)


def _rank(value: Column, ranks: dict[str, str]) -> Column:
    return reduce(lambda c, kv: c.when(value == kv[0], LEVELS.index(kv[1])), ranks.items(), F.when(F.lit(False), 0)).otherwise(1)


def risk(kind: Column, proposal_class: Column) -> Column:
    """The higher of the type's and the class's risk; a null class leaves the type's."""
    of_class = F.when(proposal_class.isNull(), 0).otherwise(_rank(proposal_class, CLASS_RISK))
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest(_rank(kind, TYPE_RISK), of_class) + 1)


def budget(tokens: Column, level: Column) -> Column:
    """Half, once or one and a half times the tokens, truncated."""
    return (tokens * F.when(level == "low", 0.5).when(level == "high", 1.5).otherwise(1.0)).cast("long")


def cost(prompt_chars: Column, completion_chars: Column) -> Column:
    """A thousandth per thousand characters."""
    return (prompt_chars + completion_chars) / 1000 * 0.001


def _duplicate_advice(a: Column, b: Column, similarity: Column, overlap: Column, context: Column, contained: Column) -> list[tuple[Column, str, Column]]:
    """Of two alike values, in order: condition, action and confidence."""
    words = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), r"(?U)\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    inside = (F.size(x) != F.size(y)) & (F.size(F.array_intersect(x, y)) == F.least(F.size(x), F.size(y)))
    named, near = (a != "") & (b != ""), context > 0
    sure, likely = similarity >= 0.95, similarity >= 0.9
    level = F.lit
    return [
        (named & (F.lower(a) == F.lower(b)), "merge", F.least(F.lit(0.95), F.greatest(similarity, F.lit(0.9)))),
        (contained & near, "merge", level(0.8)), (contained, "defer", level(0.55)),
        (sure & near, "merge", level(0.9)), (sure, "merge", level(0.85)),
        (named & likely & inside & near, "merge", level(0.8)), (named & likely & inside, "defer", level(0.5)),
        (likely & near, "merge", F.round(0.75 + F.least(context, F.lit(0.15)), 2)),
        (likely & (overlap >= 0.8), "merge", level(0.65)), (likely, "defer", level(0.45)), (F.lit(True), "defer", level(0.3)),
    ]


# What is advised for a finding's type and method (any other method: None), with its confidence.
ADVICE = {
    ("exact_node_duplicate", None): ("merge", 0.95),
    ("exact_rel_duplicate", "bidirectional_rel_duplicate"): ("delete", 0.9),
    ("exact_rel_duplicate", None): ("merge", 0.95),
    ("canonical_violation", "canonical_inverse_violation"): ("normalize", 0.9),
    ("canonical_violation", None): ("normalize", 0.5),
    ("structural_anomaly", "orphan_node"): ("delete", 0.7),
    ("structural_anomaly", "degree_outlier"): ("defer", 0.3),
    ("structural_anomaly", "missing_provenance_node"): ("normalize", 0.9),
    ("structural_anomaly", "missing_provenance_rel"): ("normalize", 0.9),
    ("structural_anomaly", "qualifier_missing"): ("normalize", 0.8),
    ("structural_anomaly", None): ("defer", 0.25),
}


def advice(kind: Column, method: Column, a: Column, b: Column, similarity: Column, overlap: Column, context: Column, contained: Column) -> tuple[Column, Column]:
    """Action and confidence for a finding; null values and scores count as empty and 0. Unknown types are deferred."""
    a, b = (F.coalesce(c, F.lit("")) for c in (a, b))
    similarity, overlap, context = (F.coalesce(c, F.lit(0.0)) for c in (similarity, overlap, context))
    pairs = _duplicate_advice(a, b, similarity, overlap, context, F.coalesce(contained, F.lit(False)))
    leaves = [((kind == "probable_duplicate") & when, act, sure) for when, act, sure in pairs]
    leaves += [((kind == k) & (F.lit(True) if m is None else method.eqNullSafe(F.lit(m))), act, F.lit(sure)) for (k, m), (act, sure) in ADVICE.items()]
    first = lambda pick, rest: reduce(lambda later, leaf: F.when(leaf[0], pick(leaf)).otherwise(later), reversed(leaves), rest)
    return first(lambda x: F.lit(x[1]), F.lit("defer")), first(lambda x: x[2], F.lit(0.2))
