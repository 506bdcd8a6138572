"""Checks that go beyond the scripted rules: each one is an extension, none is needed for parity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import quality

# Issue types that a report may use, and the counts that ask for a section of their own.
ISSUE_TYPES = ("math", "numeric", "evaluation", "claim", "layout", "checklist", "prose", "citation", "source", "submission")
EXTRA_BLOCKERS, EXTRA_MAJORS = 2, 3


def ranks(rows: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """rows with dense place, best marker and difference to the row in front, highest first."""
    order = Window.partitionBy(group).orderBy(F.desc(value), member)
    dense = Window.partitionBy(group).orderBy(F.desc(value))
    return rows.withColumns({"place": F.dense_rank().over(dense), "best": F.col(value) == F.max(value).over(Window.partitionBy(group)), "delta": F.col(value) - F.lag(value).over(order)})


def relative_gains(rows: DataFrame, group: str, member: str, value: str, baseline: str) -> DataFrame:
    """rows with the gain over the baseline member of their group, null where there is none or it is 0."""
    base = rows.where(F.col(member) == baseline).groupBy(group).agg(F.max(value).alias("_base"))
    return rows.join(base, group, "left").withColumn("gain", (F.col(value) - F.col("_base")) / F.nullif("_base", F.lit(0))).drop("_base")


def win_counts(rows: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """(member, wins): in how many groups the member has the largest value, ties counting for all."""
    best = F.max(value).over(Window.partitionBy(group))
    return rows.withColumn("_best", best).where(F.col(value) == F.col("_best")).groupBy(member).agg(F.count_distinct(group).alias("wins"))


def inconsistent(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n_values): keys that come with more than one value, as one problem type with two severities."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, sentence)."""
    split = F.transform(T.find_all(F.col("text"), r"[^.!?]+[.!?]?"), lambda s: T.replace_all(s, r"^[\s]+|[\s]+$"))
    return docs.select("doc_id", F.posexplode(split).alias("k", "sentence")).select("doc_id", (F.col("k") + 1).alias("sentence_no"), "sentence").where("sentence <> ''")


def sentences_with(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(doc_id, sentence_no, sentence, kind): sentences that hold a listed kind of promise."""
    kinds = F.filter(F.array(*[F.when(T.has(F.col("sentence"), p), F.lit(k)) for k, p in patterns.items()]), lambda k: k.isNotNull())
    return sentences(docs).withColumn("kind", F.explode(kinds))


def coverage_totals(units: DataFrame, scope: str, unit: str, total: str, reviewed: str) -> DataFrame:
    """(scope, unit, total, reviewed) with the totals of a scope and of all as rollup rows; null names a total."""
    return units.rollup(scope, unit).agg(F.sum(total).alias("total"), F.sum(reviewed).alias("reviewed"))


def severity_counts(findings: DataFrame, scope: str, severity: str, levels: list[str]) -> DataFrame:
    """One row per scope with a count for each level."""
    return tally(findings, scope, severity, levels)


def dated_name(path: Column, day: Column) -> Column:
    """Safe stem and date, joined by an underscore."""
    return F.concat(T.safe_stem(path), F.lit("_"), F.date_format(day, "yyyy-MM-dd"))


def badges_without_finding(items: DataFrame, findings: DataFrame) -> DataFrame:
    """(bundle_id, element_id): issue items of a report whose id no finding has."""
    badges = items.where("kind = 'issue' AND element_id <> ''").select("bundle_id", F.col("element_id").alias("id")).distinct()
    return badges.join(findings.select("bundle_id", "id"), ["bundle_id", "id"], "left_anti").withColumnRenamed("id", "element_id")


def out_of_range(rows: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies outside low..high; null is not outside."""
    return quality.row_rule(rows, (F.col(value) < low) | (F.col(value) > high))


def percent_sums(rows: DataFrame, keys: list[str], value: str, slack: float = 0.5) -> DataFrame:
    """(keys, total): groups whose percentages do not add up to 100."""
    return rows.groupBy(*keys).agg(F.sum(F.col(value).cast("decimal(38,6)")).alias("total")).where(F.abs(F.col("total") - 100) > slack)


def lexicon(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """(doc_id, phrase) for each listed phrase in the lower-cased text."""
    low = F.lower("text")
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases]), lambda p: p.isNotNull())
    return docs.select("doc_id", F.explode(found).alias("phrase"))


def first_sentences(docs: DataFrame, cut: str = r"\n\s*\n") -> DataFrame:
    """(doc_id, paragraph_no, sentence): the first sentence of every paragraph; cut tells paragraphs apart."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", cut)).alias("k", "par")).where(F.trim("par") != "")
    return parts.select("doc_id", (F.col("k") + 1).alias("paragraph_no"), F.trim(F.regexp_extract("par", r"^[^.!?]*[.!?]?", 0)).alias("sentence"))


def needs_extra_section(findings: DataFrame, scope: str, blocker: str = "Blocker", major: str = "Major") -> DataFrame:
    """(scope, n_blocker, n_major): scopes with two or more of the first or three or more of the second."""
    counts = findings.groupBy(scope).agg(F.count_if(F.col("severity") == blocker).alias("n_blocker"), F.count_if(F.col("severity") == major).alias("n_major"))
    return counts.where((F.col("n_blocker") >= EXTRA_BLOCKERS) | (F.col("n_major") >= EXTRA_MAJORS))


def unknown_issue_types(items: DataFrame, allowed=ISSUE_TYPES) -> DataFrame:
    """Issue items whose type is not in the domain."""
    return quality.allowed_values(items.where("kind = 'issue'"), F.col("issue_type"), list(allowed))


def majority_drift(rows: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """(member, value, usual): rows that differ from the most frequent value of their group, ties to the larger value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    usual = counts.groupBy(group).agg(F.max_by(value, F.struct("n", value)).alias("usual"))
    return rows.join(usual, group).where(F.col(value) != F.col("usual")).select(member, F.col(value).alias("value"), "usual")


def filtered_sections(rows: DataFrame, section: str, severity: str | None, issue_type: str | None) -> DataFrame:
    """(section, shown, empty): items that pass both filters; an item without a type passes the type filter."""
    tests = [F.col("severity") == severity] if severity else []
    tests += [F.col("issue_type").isNull() | (F.col("issue_type") == issue_type)] if issue_type else []
    shown = reduce(lambda a, b: a & b, tests, F.lit(True))
    return rows.groupBy(section).agg(F.count_if(shown).alias("shown")).withColumn("empty", F.col("shown") == 0)


def out_of_order(rows: DataFrame, group: str, order: str, place: str) -> DataFrame:
    """Rows with the place of the row in front where that one is larger."""
    return rows.withColumn("before", F.lag(place).over(Window.partitionBy(group).orderBy(order))).where(F.col("before") > F.col(place))


def tally(rows: DataFrame, group: str, value: str, values: list[str]) -> DataFrame:
    """One row per group with a count for each value; the values are given, so no pass is needed to find them."""
    return rows.groupBy(group).agg(*[F.count_if(F.col(value) == v).alias(v) for v in values])
