"""Data-quality constraints as data: every operator turns rows into messages (scope, level, rule_id, subject, detail).

scope names what is audited together (a bundle, a table), so that one plan audits all of them at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE = ("scope", "level", "rule_id", "subject", "detail")


def messages(rows: DataFrame, scope: Column, rule_id: str, subject: Column, detail: Column, level: str = "error") -> DataFrame:
    """One message per row."""
    return rows.select(scope.cast("string").alias("scope"), F.lit(level).alias("level"), F.lit(rule_id).alias("rule_id"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def all_messages(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def required_fields(rows: DataFrame, scope: Column, subject: Column, fields: dict[str, Column], rule_id: str, level: str = "error", when: Column | None = None, empty=lambda c: c.isNull()) -> DataFrame:
    """A message for each field that is empty, on rows where `when` holds. One pass: the fields are exploded, not scanned one by one."""
    missing = F.filter(F.array(*[F.when(empty(c), F.lit(k)) for k, c in fields.items()]), lambda k: k.isNotNull())
    kept = rows if when is None else rows.where(when)
    found = kept.select(scope.alias("_scope"), subject.alias("_subject"), F.explode(missing).alias("_field"))
    return messages(found, F.col("_scope"), rule_id, F.col("_subject"), F.col("_field"), level)


def unique_key(rows: DataFrame, scope: Column, key: Column, order: Column, rule_id: str, level: str = "error") -> DataFrame:
    """A message for every row that repeats an earlier key of its scope."""
    named = rows.select(scope.alias("_scope"), key.alias("_key"), order.alias("_order"))
    nth = F.row_number().over(Window.partitionBy("_scope", "_key").orderBy("_order"))
    return messages(named.withColumn("_nth", nth).where("_nth > 1"), F.col("_scope"), rule_id, F.col("_key"), F.col("_nth"), level)


def foreign_key(rows: DataFrame, keys: list[str], parents: DataFrame) -> DataFrame:
    """Rows whose keys occur nowhere in parents (same column names)."""
    return rows.join(parents.select(*keys).distinct(), keys, "left_anti")


def allowed_values(rows: DataFrame, value: Column, allowed: list) -> DataFrame:
    """Rows whose value is null or outside the allowed ones."""
    return rows.where(~F.coalesce(value.isin(allowed), F.lit(False)))


def expected_members(present: DataFrame, groups: list[str], member: str, expected: list, every: DataFrame | None = None) -> DataFrame:
    """(groups, member) for each expected member that a group lacks; `every` lists the groups, by default those present."""
    base = (every if every is not None else present).select(*groups).distinct()
    wanted = base.withColumn(member, F.explode(F.array(*[F.lit(m) for m in expected])))
    return wanted.join(present.select(*groups, member).distinct(), [*groups, member], "left_anti")


def declared_vs_actual(declared: DataFrame, actual: DataFrame, keys: list[str], declared_col: str, actual_col: str, default=None) -> DataFrame:
    """Declared rows whose value differs from the actual one; with a default, a missing actual counts as it."""
    joined = declared.join(actual, keys, "left")
    value = F.col(actual_col) if default is None else F.coalesce(F.col(actual_col), F.lit(default))
    return joined.withColumn(actual_col, value).where(F.col(declared_col).isNotNull() & F.col(actual_col).isNotNull() & (F.col(declared_col) != F.col(actual_col)))


def row_rule(rows: DataFrame, broken: Column) -> DataFrame:
    """Rows on which a predicate holds; null counts as not."""
    return rows.where(F.coalesce(broken, F.lit(False)))


def neither(rows: DataFrame, keys: list[str], *others: DataFrame) -> DataFrame:
    """Distinct keys of rows that are in none of the others."""
    rest = reduce(DataFrame.unionByName, [o.select(*keys) for o in others])
    return rows.select(*keys).distinct().join(rest.distinct(), keys, "left_anti")


def capped(rows: DataFrame, groups: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows of each group with the group's total and whether the listing is incomplete."""
    window = Window.partitionBy(*groups)
    listed = rows.withColumn("rank", F.row_number().over(window.orderBy(*order))).withColumn("total", F.count("*").over(window))
    return listed.where(F.col("rank") <= limit).withColumn("incomplete", F.col("total") > limit)


def summary(found: DataFrame) -> DataFrame:
    """Errors and warnings per scope; a scope passes if it has no error."""
    return found.groupBy("scope").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings")).withColumn("passed", F.col("errors") == 0)
