"""Line dedup by distinct-site spread.

Every line's hash gathers a HyperLogLog sketch of the sites it occurs on; sketches merge in the aggregation, so a line
on millions of pages moves as one small sketch per task. Lines whose estimate is near the threshold get an exact
distinct count. A line that spreads over enough sites is boilerplate, whatever stands beside it and however often it
occurs. Only a line that every one of its documents holds in the very same text stays: exact copies are left to
document dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import let
from folioscan.llm.common import join_sized, settle, unsettle

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers; its standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Standard errors around the threshold in which the exact count decides.
MARGIN_ERRORS = 4

_BLANK = r"[\x20\x09-\x0D]+"


def margin(min_sites: int) -> float:
    """Half-width of the estimates that count as near the threshold, 1 at least."""
    return max(1.0, MARGIN_ERRORS * 1.04 / (1 << LG_K) ** 0.5 * min_sites)


def normal_line(line: Column) -> Column:
    """The line with runs of white space as one space, trimmed; case and all else stay."""
    return F.trim(F.regexp_replace(line, _BLANK, " "))


def split_lines(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(row, body, pos, line, site): every non-blank line's hash and its place. row and body are the hashes of the
    identifier and of the whole text: together they name a row, or several equal ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.xxhash64(id_col).alias("row"), F.xxhash64(text).alias("body"), F.xxhash64(F.coalesce(F.col(site_col), F.lit(""))).alias("site"), F.transform(F.split(text, "\n"), normal_line).alias("lines"))
    parts = F.transform("lines", lambda x: F.when(x != "", F.xxhash64(x)))
    return rows.select("row", "body", "site", F.posexplode(parts).alias("pos", "line")).select("row", "body", "pos", "line", "site").where("line IS NOT NULL")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, spare_copies: bool = True) -> DataFrame:
    """(line, n): hashes and numbers of occurrences of the lines on at least min_sites sites, with spare_copies only of
    those in two different texts or more. A line that is a third of all rows meets in no task (join_sized)."""
    total = lines.count()
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("*").alias("n"), F.min("body").alias("least"), F.max("body").alias("most"))
    spread = sketches.select("line", "n", "least", "most", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites - margin(min_sites))
    # least and greatest tell whether there is a second text
    spread = settle(spread.where("least <> most") if spare_copies else spread, "spread")
    near = spread.where(F.col("estimate") <= min_sites + margin(min_sites)).select("line", "n")
    counted = join_sized(lines, near, ["line"], total).groupBy("line").agg(F.count_distinct("site").alias("sites"), F.first("n").alias("n")).where(F.col("sites") >= min_sites)
    return spread.where(F.col("estimate") > min_sites + margin(min_sites)).select("line", "n").unionByName(counted.select("line", "n"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, spare_copies: bool = True) -> DataFrame:
    """df with two more columns: kept_text, the text without its boilerplate lines, and n_removed.

    Without spare_copies the sites alone decide, also on lines that only one text holds.
    Other lines stay as they were, blank ones included, joined by newlines in their order. Null text counts as empty
    and gives an empty kept_text; a null site is a site of its own. A text of boilerplate alone becomes empty; its row
    stays. Texts of any length are read whole, in time that grows with their lines. Repeated rows are occurrences like
    any other and lose the same lines. An empty table gives an empty result. Extra columns stay; a kept_text or
    n_removed among them is replaced.
    """
    lines = settle(split_lines(df, id_col, text_col, site_col), "lines")
    wide = settle(boilerplate(lines, min_sites, spare_copies), "boilerplate")
    found = join_sized(lines, wide, ["line"], lines.count())
    # at most as many places as the text has lines; a place that occurs twice belongs to a row that does
    gone = found.groupBy("row", "body").agg(F.collect_set("pos").alias("places"), F.count("*").alias("all"))
    gone = settle(gone.select("row", "body", "places", (F.col("all") / F.size("places")).cast("bigint").alias("n")), "gone")
    unsettle(lines, wide)
    hidden = "_"
    while any(c.startswith(hidden) for c in df.columns):
        hidden += "_"
    row, body, places, n = (hidden + k for k in ("row", "body", "places", "n"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = df.withColumns({row: F.xxhash64(id_col), body: F.xxhash64(text)})
    out = join_sized(named, gone.toDF(row, body, places, n), [row, body], df.count(), n, "left")
    # the lines are bound once, and differences of arrays are hashed, so this takes one pass over the lines
    kept = let(F.split(text, "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(places)), lambda i: F.get(x, i)), "\n"))
    stay = [F.col(f"`{c}`") for c in df.columns if c not in ("kept_text", "n_removed")]
    return out.select(*stay, F.when(F.col(places).isNull(), text).otherwise(kept).alias("kept_text"), F.coalesce(F.size(places), F.lit(0)).cast("bigint").alias("n_removed"))
