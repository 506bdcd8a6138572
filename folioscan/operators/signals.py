"""Pattern scans, section statistics and order-aware helpers over documents (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import patterns as P
from folioscan.functions import text as T
from folioscan.operators import quality

#: Categories of text_signals: pattern, group to show (0: the whole match), and whether the plain rendering counts too.
SCANS = {
    "placeholder": P.PLACEHOLDER,
    "todo": P.TODO,
    "documentclass": P.DOCUMENT_CLASS,
    "bibliography": P.BIBLIOGRAPHY,
    "figure_caption": P.FIGURE_CAPTION,
}
#: Identity signals in the order of the summary.
IDENTITY = ("email", "github", "path", "author", "affiliation", "thanks", "orcid", "final_switch", "camera_ready", "acknowledgment")


def scan(docs: DataFrame, category: str, pattern: str) -> DataFrame:
    """(doc_id, category, line_no, value): all matches of a pattern, whole and cleaned to one line."""
    found = docs.select("doc_id", F.explode(T.matches(F.col("text"), pattern)).alias("m"))
    return found.select("doc_id", F.lit(category).alias("category"), F.col("m.line_no").alias("line_no"), T.snippet(F.col("m.match")).alias("value"))


def text_signals(docs: DataFrame) -> DataFrame:
    """All line-numbered categories of SCANS."""
    return quality.all_messages(*[scan(docs, k, p) for k, p in SCANS.items()])


def commands(docs: DataFrame) -> DataFrame:
    """(doc_id, category, ord, label, value): sections with their level, captions, title, abstract, document classes."""
    text = F.col("text")

    def part(category: str, label: Column, value: Column) -> DataFrame:
        items = F.zip_with(label, value, lambda a, b: F.struct(a.alias("label"), T.one_line(b).alias("value")))
        return docs.select("doc_id", F.lit(category).alias("category"), F.posexplode(items).alias("ord", "i")).select("doc_id", "category", "ord", "i.label", "i.value")

    none = lambda a: F.transform(a, lambda _: F.lit(None).cast("string"))
    single = {"caption": (P.CAPTION, 1), "title": (P.TITLE, 1), "abstract": (P.ABSTRACT, 1), "documentclass": (P.DOCUMENT_CLASS, 1)}
    parts = [part(k, none(T.find_all(text, p, g)), T.find_all(text, p, g)) for k, (p, g) in single.items()]
    return quality.all_messages(part("section", T.find_all(text, P.SECTION_COMMAND, 1), T.find_all(text, P.SECTION_COMMAND, 2)), *parts)


def title_and_abstract(docs: DataFrame) -> DataFrame:
    """(doc_id, title, abstract_words): the first of each; null and 0 if there is none."""
    first = lambda p: T.one_line(F.get(T.find_all(F.col("text"), p, 1), F.lit(0)))
    return docs.select("doc_id", F.nullif(first(P.TITLE), F.lit("")).alias("title"), T.words(first(P.ABSTRACT)).alias("abstract_words"))


def key_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, refs, cites, distinct_cites): comma-separated items of reference and citation commands."""
    items = lambda p: F.filter(F.flatten(F.transform(T.find_all(F.col("text"), p, 1), lambda g: F.transform(F.split(g, ","), lambda k: F.trim(k)))), lambda k: k != "")
    return docs.select("doc_id", F.size(items(P.REFERENCE)).alias("refs"), F.size(items(P.CITATION)).alias("cites"), F.size(F.array_distinct(items(P.CITATION))).alias("distinct_cites"))


def identity(docs: DataFrame, limit: int = 100) -> DataFrame:
    """(doc_id, category, rank, value): identity signals in fixed order, capped per category and then over all.

    docs may have a column plain with the rendered text; addresses, links, paths and switches are looked for in both.
    """
    both = F.concat_ws("\n", "text", "plain") if "plain" in docs.columns else F.col("text")
    distinct = lambda a: F.array_sort(F.array_distinct(a))
    thanks = F.transform(T.find_all(F.col("text"), P.THANKS, 1), T.one_line)
    acknowledged = T.has(F.col("text"), P.ACKNOWLEDGEMENT) | T.has(F.col("plain") if "plain" in docs.columns else F.col("text"), P.ACKNOWLEDGEMENT_TEXT)
    found = {
        "email": distinct(T.find_all(both, P.EMAIL)),
        "github": distinct(T.find_all(both, P.GITHUB)),
        "path": distinct(T.find_all(both, P.HOME_PATH)),
        "author": T.payloads(F.col("text"), P.AUTHOR),
        "affiliation": T.payloads(F.col("text"), P.AFFILIATION),
        "thanks": thanks,
        "orcid": distinct(T.find_all(both, P.ORCID, 1)),
        "final_switch": distinct(T.find_all(both, P.FINAL_SWITCH)),
        "camera_ready": distinct(T.find_all(both, P.CAMERA_READY)),
        "acknowledgment": F.when(acknowledged, F.array(F.lit("acknowledgments section"))).otherwise(F.array().cast("array<string>")),
    }

    def named_items(category: str) -> Column:
        return F.transform(F.slice(found[category], 1, limit), lambda v: F.struct(F.lit(category).alias("category"), F.substring(v, 1, 300).alias("value")))

    named = [named_items(k) for k in IDENTITY]
    capped = docs.select("doc_id", F.posexplode(F.slice(F.concat(*named), 1, T.positive(limit))).alias("k", "i"))
    return capped.select("doc_id", "i.category", (F.col("k") + 1).alias("rank"), "i.value")


def segments(lines: DataFrame, is_heading: Column, title: Column, keep_empty: bool = False) -> DataFrame:
    """(doc_id, section_no, title, n_words, n_cites) from lines(doc_id, line_no, line): text between headings, the part
    before the first as section 0. Sections without words are left out unless keep_empty."""
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.coalesce(is_heading, F.lit(False))
    cut = lines.withColumn("_head", head).withColumn("_title", title).withColumn("section_no", F.sum(F.col("_head").cast("bigint")).over(upto))
    body = F.when(~F.col("_head"), F.col("line"))
    out = cut.groupBy("doc_id", "section_no").agg(F.max(F.when(F.col("_head"), F.col("_title"))).alias("title"), F.sum(T.words(body)).alias("n_words"), F.sum(T.citation_marks(body)).alias("n_cites"))
    return out if keep_empty else out.where("n_words > 0")


def section_word_stats(docs: DataFrame, limit: int = 100) -> DataFrame:
    """(doc_id, section_no, title, n_words, n_cites, density): numbered, common and markdown headings cut the text;
    a text without headings is one section. Text in front of the first heading belongs to none."""
    lines = docs.select("doc_id", F.posexplode(T.text_lines(F.col("text"))).alias("line_no", "line"))
    markdown = F.regexp_extract("line", P.MARKDOWN_HEADING_LINE, 1)
    plain = F.regexp_extract("line", P.PLAIN_HEADING_LINE, 1)
    head = (markdown != "") | T.has(F.col("line"), P.PLAIN_HEADING_LINE)
    title = F.coalesce(F.nullif(markdown, F.lit("")), F.nullif(plain, F.lit("")), F.nullif(F.regexp_extract("line", P.PLAIN_HEADING_LINE, 3), F.lit("")), F.trim("line"))
    cut = segments(lines, head, F.trim(title), keep_empty=True)
    last = F.max("section_no").over(Window.partitionBy("doc_id"))
    cut = cut.withColumn("_last", last)
    whole = cut.where("_last = 0").withColumn("title", F.lit("Whole extracted text"))
    cut = cut.where("_last > 0 AND section_no BETWEEN 1 AND " + str(T.positive(limit)) + " AND n_words > 0")
    return whole.unionByName(cut).drop("_last").withColumn("density", T.per_thousand(F.col("n_cites"), F.col("n_words")))


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, heading): heading-like lines of extracted text."""
    lines = docs.select("doc_id", F.posexplode(T.text_lines(F.col("text"))).alias("k", "line"))
    return lines.where(T.has(F.col("line"), P.PLAIN_HEADING_LINE)).select("doc_id", (F.col("k") + 1).alias("line_no"), F.trim("line").alias("heading"))


def summary(docs: DataFrame, kind: str = "latex", limit: int = 100) -> DataFrame:
    """(doc_id, section, ord, item): the review summary as rows, in a fixed order of sections; each is capped per
    document. kind: "latex" for source, "pdf" for extracted text."""
    from folioscan.operators import symbols, tables

    parts: list[tuple[str, DataFrame]] = []

    def add(section: str, rows: DataFrame, item: Column, *order: Column) -> None:
        listed = rows.select("doc_id", item.cast("string").alias("item"), F.struct(*order, item).alias("_by"))
        ranked = listed.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("_by"))).where(F.col("ord") <= T.positive(limit))
        parts.append((section, ranked.select("doc_id", "ord", "item")))

    lined = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col("value"))
    if kind == "latex":
        found = commands(docs)
        add("class", found.where("category = 'documentclass'"), F.col("value"), F.col("ord"))
        add("title", title_and_abstract(docs), F.concat(F.coalesce("title", F.lit("not detected")), F.lit(" | abstract words "), F.col("abstract_words").cast("string")))
        add("sections", found.where("category = 'section'"), F.concat_ws(": ", "label", "value"), F.col("ord"))
        add("captions", found.where("category = 'caption'"), F.coalesce(F.nullif(F.substring("value", 1, 500), F.lit("")), F.lit("empty caption")), F.col("ord"))
        add("tables", tables.table_sanity(docs, limit), F.concat_ws(" ", F.lit("table"), F.col("table_no").cast("string"), F.lit("row"), F.col("row_no").cast("string"), "detail"), F.col("category"), F.col("rank"))
        add("equations", symbols.equations(docs), F.concat_ws(": ", "label", F.substring(T.one_line(F.col("body")), 1, 500)), F.col("eq_no"))
        add("symbols", symbols.symbol_signals(docs), F.concat_ws(": ", "kind", "subject", "detail"), F.col("ord"))
        add("keys", key_counts(docs), F.concat_ws(", ", F.concat(F.lit("refs "), "refs"), F.concat(F.lit("cites "), "cites"), F.concat(F.lit("distinct "), "distinct_cites")))
    else:
        add("headings", headings(docs), F.col("heading"), F.col("line_no"))
        add("captions", scan(docs, "figure_caption", P.FIGURE_CAPTION), F.substring("value", 1, 500), F.col("line_no"))
        add("numbers", tables.line_signals(docs, limit), tables.signal_sentence(), F.col("line_no"))
    plain = docs if kind == "pdf" else docs.withColumn("text", T.plain_text(F.col("text")))
    add("words", section_word_stats(plain, limit), F.concat_ws(" | ", "title", F.col("n_words").cast("string"), F.col("n_cites").cast("string"), "density"), F.col("section_no"))
    add("placeholders", scan(docs, "placeholder", P.PLACEHOLDER), lined, F.col("line_no"))
    add("todos", scan(docs, "todo", P.TODO), lined, F.col("line_no"))
    add("identity", identity(docs, limit), F.concat_ws(": ", "category", "value"), F.col("rank"))
    return quality.all_messages(*[rows.select("doc_id", F.lit(f"{k:02d} {name}").alias("section"), "ord", "item") for k, (name, rows) in enumerate(parts)])


# --- order-aware helpers --------------------------------------------------------------------------------------------


def carry_forward(rows: DataFrame, groups: list[str], order: list[str], value: Column, name: str, frame: tuple[int, int]) -> DataFrame:
    """rows with the last non-null value of a frame: unbounded for a header, bounded for an as-of with a lookback."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(*frame)))


def epochs(rows: DataFrame, groups: list[str], order: list[str], resets: Column, name: str = "epoch") -> DataFrame:
    """rows with the number of resets so far, this row included."""
    upto = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.coalesce(resets, F.lit(False)).cast("bigint")).over(upto))


def pairs_present(rows: DataFrame, tokens: str, pairs) -> DataFrame:
    """Rows with columns first and second for each listed pair of which both members are among the tokens."""
    listed = F.filter(F.array(*[F.when(F.array_contains(tokens, a) & F.array_contains(tokens, b), F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"))) for a, b in pairs]), lambda p: p.isNotNull())
    return rows.withColumn("_pair", F.explode(listed)).withColumns({"first": F.col("_pair.first"), "second": F.col("_pair.second")}).drop("_pair")


def redefinitions(definitions: DataFrame, preview: int = 3) -> DataFrame:
    """(doc_id, name, n_distinct, preview) from definitions(doc_id, name, expansion, ord): names with more than one
    distinct expansion, the first ones in first-seen order."""
    firsts = definitions.groupBy("doc_id", "name", "expansion").agg(F.min("ord").alias("ord"))
    window = Window.partitionBy("doc_id", "name")
    ranked = firsts.withColumn("i", F.row_number().over(window.orderBy("ord"))).withColumn("n", F.count("*").over(window)).where(f"n > 1 AND i <= {preview}")
    grouped = ranked.groupBy("doc_id", "name").agg(F.max("n").alias("n_distinct"), F.array_sort(F.collect_list(F.struct("i", "expansion"))).alias("p"))
    return grouped.select("doc_id", "name", "n_distinct", F.col("p.expansion").alias("preview"))
