"""Comparison of two review runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.quality import all_messages

SEVERITY_RANKS = {"Polish": 0, "Minor": 1, "Major": 2, "Blocker": 3}


def finding_key(finding_id: Column, location: Column, *dimensions: Column) -> Column:
    """The identifier, or location and the first dimension that is not empty, both lower-cased."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    first = F.coalesce(*[F.nullif(d, F.lit("")) for d in dimensions], F.lit(""))
    return F.coalesce(F.nullif(finding_id, F.lit("")), F.concat(clean(location), F.lit("::"), clean(first)))


def latest(run: DataFrame) -> DataFrame:
    """The last row in ord of every (scope, key)."""
    return run.groupBy("scope", "key").agg(F.max_by(F.struct("severity", "rationale"), "ord").alias("r")).select("scope", "key", F.col("r.severity").alias("severity"), F.col("r.rationale").alias("rationale"))


def compare(first: DataFrame, second: DataFrame, ranks: dict[str, int] = SEVERITY_RANKS) -> DataFrame:
    """(scope, key, kind, level, detail) from two runs (scope, key, severity, rationale, ord).

    kind: only_in_first, only_in_second, severity (with the distance of ranks, or unknown) and rationale. One full
    outer join serves all four; of repeated keys the last counts.
    """
    a, b = latest(first).alias("a"), latest(second).alias("b")
    both = a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.key") == F.col("b.key")), "full")
    both = both.select(F.coalesce("a.scope", "b.scope").alias("scope"), F.coalesce("a.key", "b.key").alias("key"), F.col("a.key").isNotNull().alias("ina"), F.col("b.key").isNotNull().alias("inb"), F.col("a.severity").alias("sa"), F.col("b.severity").alias("sb"), F.coalesce("a.rationale", F.lit(False)).alias("ra"), F.coalesce("b.rationale", F.lit(False)).alias("rb"))
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    distance = F.coalesce(F.abs(F.try_element_at(table, "sa") - F.try_element_at(table, "sb")).cast("string"), F.lit("unknown"))
    shown = lambda c: F.coalesce(F.col(c), F.lit("None"))
    moved = F.concat(shown("sa"), F.lit(" -> "), shown("sb"), F.lit(" (distance "), distance, F.lit(")"))
    found_if = lambda cond, kind, level, detail: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), detail.alias("detail")))
    no_detail, in_both = F.lit(None).cast("string"), F.col("ina") & F.col("inb")
    kinds = F.array(
        found_if(~F.col("inb"), "only_in_first", "warning", no_detail),
        found_if(~F.col("ina"), "only_in_second", "warning", no_detail),
        found_if(in_both & ~F.col("sa").eqNullSafe(F.col("sb")), "severity", "error", moved),
        found_if(in_both & (F.col("ra") != F.col("rb")), "rationale", "warning", F.concat(F.col("ra").cast("string"), F.lit(" -> "), F.col("rb").cast("string"))),
    )
    found = both.select("scope", "key", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return found.select("scope", "key", "k.kind", "k.level", "k.detail")


def histogram(first: DataFrame, second: DataFrame) -> DataFrame:
    """(scope, severity, first, second): findings by severity in both runs, a placeholder for none."""
    every = all_messages(first.select("scope", "severity", F.lit("first").alias("run")), second.select("scope", "severity", F.lit("second").alias("run")))
    return every.groupBy("scope", F.coalesce("severity", F.lit("<missing>")).alias("severity")).agg(F.count_if(F.col("run") == "first").alias("first"), F.count_if(F.col("run") == "second").alias("second"))


def findings(bundles: DataFrame, column: str = "findings") -> DataFrame:
    """Run rows (scope, key, severity, rationale, ord) from bundles(bundle_id, findings JSON)."""
    from folioscan.operators.artifacts import elements, string

    rows = elements(bundles, column, "findings")
    f = lambda k: string("v", k)
    return rows.select(F.col("bundle_id").alias("scope"), finding_key(f("id"), f("location"), f("check_dimension"), f("claim_type"), f("verification_method")).alias("key"), f("severity").alias("severity"), F.coalesce(F.length(f("severity_rationale")) > 0, F.lit(False)).alias("rationale"), "ord")
