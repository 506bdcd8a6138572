"""Numeric audit of tables: printed summaries against means of the printed values they summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import patterns as P
from folioscan.functions import text as T

_BREAK = r"(?<!\\)\\\\"
_RULE = r"^\\(?:toprule|midrule|bottomrule|hline)\s*$"


def discrepancies(rows: DataFrame, reported: Column, computed: Column, decimals: Column) -> DataFrame:
    """rows whose reported value is further from the computed one than its print allows, with the columns
    visible_computed_value, delta, gap_tier, gap_abs and gap_rel_percent."""
    found = rows.where(F.abs(reported - computed) > T.tolerance(decimals)).withColumn("_gap", T.gap(reported, computed))
    return found.select(
        *rows.columns,
        T.number_text(computed, decimals).alias("visible_computed_value"),
        T.signed_text(reported - computed, decimals).alias("delta"),
        F.col("_gap.tier").alias("gap_tier"),
        F.col("_gap.gap_abs").alias("gap_abs"),
        F.col("_gap.gap_rel").alias("gap_rel_percent"),
    )


def last_against_mean(rows: DataFrame, key: str, order: list[str], value: str, decimals: int = 2) -> DataFrame:
    """Per key: the last value in order as the summary of the values before it (two at least). One grouped pass with
    partial aggregation, no window: the mean of the others is the total without the last."""
    last = F.max(F.struct(*order, value)).alias("_last")
    groups = rows.groupBy(key).agg(last, F.sum(value).alias("_sum"), F.count(value).alias("_n")).where("_n >= 3")
    groups = groups.select(key, F.col(f"_last.{value}").alias("reported"), (F.col("_n") - 1).alias("component_count"), ((F.col("_sum") - F.col(f"_last.{value}")) / (F.col("_n") - 1)).alias("computed"))
    return discrepancies(groups, F.col("reported"), F.col("computed"), F.lit(decimals))


def running_mean(rows: DataFrame, key: str, order: list[str], value: str, decimals: int = 2) -> DataFrame:
    """Per key and row: the value against the mean of all earlier ones (two at least)."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    named = rows.withColumn("component_count", F.count(value).over(before)).withColumn("computed", F.sum(value).over(before) / F.count(value).over(before))
    return discrepancies(named.where("component_count >= 2"), F.col(value), F.col("computed"), F.lit(decimals))


def mean_of_means(rows: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Per key with more than one group: the mean of the groups' means beside the plain mean."""
    parts = rows.groupBy(key, group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    whole = parts.groupBy(key).agg(F.count("*").alias("groups"), F.avg(F.col("_s") / F.col("_n")).alias("grouped_mean"), (F.sum("_s") / F.sum("_n")).alias("plain_mean"))
    return whole.where("groups > 1")


# --- LaTeX ----------------------------------------------------------------------------------------------------------


def table_rows(docs: DataFrame, escaped_percent: bool = False) -> DataFrame:
    """(doc_id, table_no, row_no, cells): rows of tabular-like environments. Empty and rule-only rows are left out but
    keep their number. A row ends at its first percent sign, or with escaped_percent at its first unescaped one."""
    tables = docs.select("doc_id", F.posexplode(T.find_all(F.col("text"), P.TABULAR, 2)).alias("t", "body"))
    body = T.replace_all(F.col("body"), r"^\s*(?:\{[^{}]*\}){1,2}")
    rows = tables.select("doc_id", (F.col("t") + 1).alias("table_no"), F.posexplode(F.split(body, _BREAK)).alias("r", "raw"))
    comment = r"(?<!\\)%.*" if escaped_percent else "%.*"
    clean = T.replace_all(T.replace_all(F.col("raw"), comment), r"(?U)^\s+|\s+$")
    rows = rows.select("doc_id", "table_no", (F.col("r") + 1).alias("row_no"), clean.alias("clean")).where((F.col("clean") != "") & ~T.has(F.col("clean"), _RULE))
    return rows.select("doc_id", "table_no", "row_no", F.transform(T.split_cells(F.col("clean")), T.cell_text).alias("cells"))


def _marked(rows: DataFrame) -> DataFrame:
    """rows with their numbers, the header that applies to each, and flags; header rows themselves are left out."""
    numbers = F.transform("cells", T.first_number)
    rows = rows.withColumn("numbers", numbers).withColumn("numeric", F.size(F.filter("numbers", lambda n: n.isNotNull())))
    named = F.exists("cells", lambda c: T.has(c, P.SUMMARY_COLUMN))
    rows = rows.withColumn("is_header", named & (F.col("numeric") < F.greatest(F.lit(1), F.floor(F.size("cells") / 2))))
    before = Window.partitionBy("doc_id", "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("header", F.last(F.when(F.col("is_header"), F.col("cells")), ignorenulls=True).over(before)).where(~F.col("is_header"))
    return rows.withColumn("is_summary", T.has(F.trim(F.lower(F.get("cells", F.lit(0)))), P.SUMMARY_ROW))


def column_signals(rows: DataFrame) -> DataFrame:
    """Summary columns: each number under a summary header against the mean of all numbers left of it but the first
    column's, two at least. Works inside a row, so only the header's carry-forward needs a window."""
    marked = _marked(rows)

    def item(n: Column, k: Column) -> Column:
        left = F.filter(F.slice("numbers", F.lit(2), F.greatest(k - 1, F.lit(0))), lambda c: c.isNotNull())
        total = F.aggregate(left, F.lit(0.0), lambda a, c: a + c["value"])
        head = F.get("header", k)
        ok = n.isNotNull() & (k < F.size("header")) & T.has(head, P.SUMMARY_COLUMN) & (F.size(left) >= 2)
        return F.when(ok, F.struct((k + 1).alias("column_no"), head.alias("column_label"), n.alias("n"), (total / F.size(left)).alias("computed"), F.size(left).alias("component_count")))

    found = marked.where("header IS NOT NULL").select("doc_id", "table_no", "row_no", F.get("cells", F.lit(0)).alias("row_label"), F.explode(F.filter(F.transform("numbers", item), lambda x: x.isNotNull())).alias("s"))
    return _signals(found, "column")


def row_signals(rows: DataFrame) -> DataFrame:
    """Summary rows: each number against the mean of its column over the earlier data rows of the table, two at least."""
    marked = _marked(rows).withColumn("is_data", (F.col("numeric") >= 2) & ~F.col("is_summary"))
    before = Window.partitionBy("doc_id", "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("data_rows", F.coalesce(F.sum(F.col("is_data").cast("int")).over(before), F.lit(0)))
    cells = marked.select("doc_id", "table_no", "row_no", F.get("cells", F.lit(0)).alias("row_label"), "header", "is_data", "is_summary", "data_rows", F.posexplode("numbers").alias("k", "n")).where("k > 0 AND n IS NOT NULL")
    up = Window.partitionBy("doc_id", "table_no", "k").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    value = F.when(F.col("is_data"), F.col("n.value"))
    cells = cells.withColumn("count", F.count(value).over(up)).withColumn("total", F.sum(value).over(up)).where("is_summary AND data_rows >= 2 AND count >= 2")
    label = F.coalesce(F.get("header", F.col("k")), F.concat(F.lit("column "), (F.col("k") + 1).cast("string")))
    found = cells.select("doc_id", "table_no", "row_no", "row_label", F.struct((F.col("k") + 1).alias("column_no"), label.alias("column_label"), "n", (F.col("total") / F.col("count")).alias("computed"), F.col("count").alias("component_count")).alias("s"))
    return _signals(found, "row")


def _signals(found: DataFrame, scope: str) -> DataFrame:
    flat = found.select("doc_id", "table_no", "row_no", "row_label", F.lit(scope).alias("scope"), "s.column_no", "s.column_label", F.col("s.n.text").alias("reported_value"), F.col("s.component_count").cast("bigint").alias("component_count"), F.col("s.n.value").alias("_v"), F.col("s.n.decimals").alias("_d"), F.col("s.computed").alias("_c"))
    return discrepancies(flat, F.col("_v"), F.col("_c"), F.col("_d")).drop("_v", "_d", "_c")


def table_signals(docs: DataFrame, escaped_percent: bool = False) -> DataFrame:
    """All summary discrepancies of the documents' LaTeX tables."""
    rows = table_rows(docs, escaped_percent)
    return column_signals(rows).unionByName(row_signals(rows))


def blank_cells(rows: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, columns): 1-based columns that are empty or hold a placeholder."""
    marks = F.array(*[F.lit(p) for p in P.PLACEHOLDER_CELLS])
    at = F.filter(F.transform("cells", lambda c, k: F.when((c == "") | F.array_contains(marks, c), k + 1)), lambda k: k.isNotNull())
    return rows.select("doc_id", "table_no", "row_no", at.alias("columns")).where(F.size("columns") > 0)


def ragged_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, n_cells, expected): rows with fewer cells than an earlier row of their table."""
    upto = Window.partitionBy("doc_id", "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.withColumn("n_cells", F.size("cells")).withColumn("expected", F.max(F.size("cells")).over(upto))
    return sized.where("n_cells < expected").select("doc_id", "table_no", "row_no", "n_cells", "expected")


def table_sanity(docs: DataFrame, limit: int = 100) -> DataFrame:
    """(doc_id, category, table_no, row_no, detail, rank, total, incomplete): blank and ragged rows, then numeric
    signals, each category capped per document with a flag where the cap cuts."""
    rows = table_rows(docs)
    text = lambda c: F.array_join(c.cast("array<string>"), ", ")
    parts = [
        blank_cells(rows).select("doc_id", F.lit("cells").alias("category"), "table_no", "row_no", F.concat(F.lit("blank at "), text(F.col("columns"))).alias("detail")),
        ragged_rows(rows).select("doc_id", F.lit("cells").alias("category"), "table_no", "row_no", F.concat_ws(" of ", F.col("n_cells").cast("string"), F.col("expected").cast("string")).alias("detail")),
        table_signals(docs).select("doc_id", F.lit("numeric").alias("category"), "table_no", "row_no", F.concat_ws(" | ", "reported_value", "visible_computed_value", "delta", "gap_tier").alias("detail")),
    ]
    from folioscan.operators.quality import all_messages, capped

    return capped(all_messages(*parts), ["doc_id", "category"], [F.col("table_no"), F.col("row_no"), F.col("detail")], limit)


# --- lines of PDF text ----------------------------------------------------------------------------------------------


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line)."""
    return docs.select("doc_id", F.posexplode(T.text_lines(F.col("text"))).alias("k", "line")).select("doc_id", (F.col("k") + 1).alias("line_no"), "line")


def line_signals(docs: DataFrame, limit: int | None = 100, tags=P.GROUP_TAGS, lookback: int = 30) -> DataFrame:
    """Summary discrepancies of table rows in extracted text.

    Three carry-forward columns hold the state a line is read in: a table line clears group tags and summary columns,
    another heading clears summary columns, a line of tags sets tags and clears columns, a summary header sets columns.
    Rows with tags for all numbers but the last are checked as a mean of group means; others as means of the numbers
    between summary columns. table_id is the nearest table line at most `lookback` lines back, this one included.
    """
    none_int, none_text = F.array().cast("array<int>"), F.array().cast("array<string>")
    rows = text_lines(docs).withColumn("own_tags", T.group_tags(F.col("line"), tags)).withColumn("own_cols", T.summary_positions(F.col("line")))
    tagged = F.size("own_tags") > 0
    headed = ~tagged & (F.size("own_cols") > 0)
    table, other = T.has(F.col("line"), P.TABLE_LINE), T.has(F.col("line"), P.OTHER_LINE)
    rows = rows.withColumn("new_tags", F.when(tagged, F.col("own_tags")).when(table, none_text)).withColumn("new_cols", F.when(headed, F.col("own_cols")).when(tagged | table | other, none_int))
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-(lookback - 1), 0)
    name = F.nullif(F.regexp_extract("line", f"({P.TABLE_LINE})", 1), F.lit(""))
    rows = rows.withColumns({"tags": F.coalesce(F.last("new_tags", True).over(upto), none_text), "cols": F.coalesce(F.last("new_cols", True).over(upto), none_int), "table_id": F.coalesce(F.last(name, True).over(near), F.lit("PDF table"))})
    rows = rows.where(~tagged & ~headed).withColumn("numbers", T.all_numbers(F.col("line"))).withColumn("row_label", T.row_label(F.col("line")))
    count = F.size("numbers")
    rows = rows.where((count >= 4) & ~(T.has(F.col("line"), r"^\s*\d+\s+") & (count < 5)) & ~T.has(F.col("row_label"), P.NOT_A_ROW) & T.has(F.col("row_label"), P.LETTER))

    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["value"]) / F.size(a)
    candidate = lambda n, parts, computed, formula, at: F.struct(n.alias("n"), F.transform(parts, lambda p: p["text"]).alias("component_values"), computed.alias("computed"), F.lit(formula).alias("formula"), at.cast("int").alias("summary_column_index"))
    parts = F.slice("numbers", F.lit(1), count - 1)
    paired = F.zip_with(F.col("tags"), parts, lambda t, n: F.struct(t.alias("tag"), n["value"].alias("value")))
    groups = F.transform(F.array_distinct("tags"), lambda t: F.struct(t.alias("tag"), F.transform(F.filter(paired, lambda p: p["tag"] == t), lambda p: p["value"]).alias("values")))
    means = F.transform(groups, lambda g: F.aggregate(g["values"], F.lit(0.0), lambda s, x: s + x) / F.size(g["values"]))
    grouped = (F.size("tags") == count - 1) & (F.size(F.array_distinct("tags")) > 1)
    by_group = F.array(candidate(F.element_at("numbers", -1), parts, F.aggregate(means, F.lit(0.0), lambda s, x: s + x) / F.size(means), "component_mean_of_means", F.lit(None)))

    def scoped(at: Column, k: Column) -> Column:
        start = F.when(k > 0, F.get("cols", k - 1) + 1).otherwise(F.lit(0))
        own = F.slice("numbers", start + 1, F.greatest(at - start, F.lit(0)))
        return F.when(F.size(own) >= 2, candidate(F.get("numbers", at), own, mean(own), "header_summary_mean", at))

    by_header = F.filter(F.transform("cols", scoped), lambda c: c.isNotNull())
    found = F.when(grouped, by_group).when((F.size("cols") > 0) & (F.array_max("cols") < count), by_header)
    rows = rows.select("doc_id", "table_id", "line_no", "row_label", F.when(grouped, groups).alias("component_groups"), F.posexplode(found).alias("k", "c"))
    rows = rows.where(~((F.col("c.n.value") > 500) & (F.col("c.n.decimals") == 0)))
    flat = rows.select("doc_id", "table_id", "line_no", "row_label", "k", F.col("c.n.text").alias("reported_value"), "c.component_values", F.size("c.component_values").cast("bigint").alias("component_count"), "c.formula", "c.summary_column_index", "component_groups", F.col("c.n.value").alias("_v"), F.col("c.n.decimals").alias("_d"), F.col("c.computed").alias("_c"))
    out = discrepancies(flat, F.col("_v"), F.col("_c"), F.col("_d")).drop("_v", "_d", "_c")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "k"))
    out = out.withColumn("nth", nth) if limit is None else out.withColumn("nth", nth).where(F.col("nth") <= T.positive(limit))
    out = out.withColumns({"signal_id": F.concat(F.lit("N"), F.col("nth").cast("string")), "render_required": F.lit(True), "required_severity": F.lit("Blocker"), "gap_abs": F.round("gap_abs", 4), "gap_rel_percent": F.round("gap_rel_percent", 4)})
    return out.drop("k", "nth")


def signal_sentence() -> Column:
    """A line signal as one sentence."""
    two = lambda c: F.call_function("format_number", F.col(c), F.lit("0.00"))
    return F.concat(F.lit("Signal ("), F.col("gap_tier"), F.lit(" gap "), two("gap_abs"), F.lit("pp / "), two("gap_rel_percent"), F.lit("%): "), F.col("table_id"), F.lit(", line "), F.col("line_no").cast("string"), F.lit(", row '"), F.col("row_label"), F.lit("': reported "), F.col("reported_value"), F.lit("; mean of "), F.col("component_count").cast("string"), F.lit(" cells = "), F.col("visible_computed_value"), F.lit("; delta "), F.col("delta"))


#: What the payload says about itself.
PAYLOAD_NOTE = "Means are recomputed from the printed cells; every signal needs a look at its table."


def numeric_payload(signals: DataFrame) -> DataFrame:
    """(doc_id, json): the signals of a document as one JSON object with their count and a note."""
    item = F.struct(*[c for c in signals.columns if c != "doc_id"])
    grouped = signals.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("signals"))
    return grouped.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("input"), F.size("signals").alias("signal_count"), "signals", F.lit(PAYLOAD_NOTE).alias("note"))).alias("json"))
