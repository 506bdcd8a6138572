"""Registered queries that run the document operators on text made from the tables.

Each adapter writes LaTeX, extracted text or a project from the rows of a table with some of its signals left out by
remainders of the key; the SQL states from the same rows what the operators must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import bibliography, extensions, signals, symbols, tables
from folioscan.plans.catalogue import _TIER, LINE_ORDER, ORACLE_SQL, QUERIES, _query, _t
from folioscan.sources import projects

__all__ = ["ORACLE_SQL", "QUERIES"]

#: An order's lines in their order, told apart in full, for SQL.
_LINES = """l AS (SELECT l_orderkey AS doc_id, l_quantity AS q, l_linenumber AS m, row_number() OVER w AS r, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity))"""


def _orders(spark, sf_dir, least: int = 1) -> DataFrame:
    """(doc_id, items): the lines of every order in their order."""
    item = F.struct(*LINE_ORDER, "l_quantity")
    rows = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.where(F.size("items") >= least)


def _text(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _when(condition, text: str, other: str = "") -> F.Column:
    return F.when(condition, F.lit(text)).otherwise(F.lit(other))


# --- tables -----------------------------------------------------------------------------------------------------------


def _summary_tables(spark, sf_dir) -> DataFrame:
    """Every order of three or more lines as a table: lines as data rows, the last one as the printed mean."""
    rows = _orders(spark, sf_dir, 3)
    n = F.size("items")
    line = F.transform("items", lambda i, k: F.concat(F.when(k == n - 1, F.lit("Mean")).otherwise(F.lit("row")), F.lit(" & "), T.number_text(i["l_quantity"], F.lit(2)), F.lit(" & "), i["l_linenumber"].cast("string"), F.lit(" \\\\")))
    text = F.concat(F.lit("\\begin{tabular}{lrr}\nName & Quantity & Line \\\\\n\\midrule\n"), F.array_join(line, "\n"), F.lit("\n\\end{tabular}\n"))
    return rows.select("doc_id", text.alias("text"))


@_query(f"""WITH {_LINES}, s AS (SELECT doc_id, max(n) - 1 AS c, max(CASE WHEN r = n THEN q END) AS q, max(CASE WHEN r = n THEN m END) AS m,
  sum(CASE WHEN r < n THEN q END) AS sq, sum(CASE WHEN r < n THEN m END) AS sm FROM l WHERE n >= 3 GROUP BY doc_id),
u AS (SELECT doc_id, c, 2 AS column_no, q AS reported, sq / c AS computed, 0.005 AS slack, printf('%.2f', q) AS reported_value FROM s
  UNION ALL SELECT doc_id, c, 3, CAST(m AS DOUBLE), CAST(sm AS DOUBLE) / c, 0.5, CAST(m AS VARCHAR) FROM s)
SELECT doc_id, CAST(column_no AS INTEGER) AS column_no, CAST(c AS BIGINT) AS component_count, reported_value, printf('%.2f', computed) AS visible_computed_value, printf('%+.2f', reported - computed) AS delta, {_TIER} AS gap_tier
FROM u WHERE abs(reported - computed) > slack""")
def q44_summary_rows(spark, sf_dir):
    """The last row of each order's table against the means of the rows above it."""
    found = tables.row_signals(tables.table_rows(_summary_tables(spark, sf_dir)))
    return found.select("doc_id", "column_no", "component_count", "reported_value", "visible_computed_value", "delta", "gap_tier")


def _ragged_tables(spark, sf_dir) -> DataFrame:
    """Every order as a table whose rows have as many cells as the line's number leaves, some of them placeholders."""
    mark = F.array(*[F.lit(p) for p in ("", "--", "N/A", "?")])
    cell = lambda i: F.when(i["l_quantity"] % 10 == 0, F.element_at(mark, (i["l_linenumber"] % 4 + 1).cast("int"))).otherwise(T.number_text(i["l_quantity"], F.lit(2)))
    line = F.transform("items", lambda i: F.concat(F.lit("row & "), cell(i), F.repeat(F.lit(" & x"), (i["l_linenumber"] % 3).cast("int"))))
    text = F.concat(F.lit("\\begin{array}{lrr}\n"), F.array_join(line, " \\\\\n"), F.lit("\n\\end{array}\n"))
    return _orders(spark, sf_dir).select("doc_id", text.alias("text"))


@_query(f"WITH {_LINES} SELECT doc_id, CAST(r AS INTEGER) AS row_no, '2' AS columns FROM l WHERE q % 10 = 0")
def q45_blank_cells(spark, sf_dir):
    """Empty and placeholder cells."""
    found = tables.blank_cells(tables.table_rows(_ragged_tables(spark, sf_dir)))
    return found.select("doc_id", "row_no", F.array_join(F.col("columns").cast("array<string>"), ",").alias("columns"))


@_query(f"""WITH {_LINES}, w AS (SELECT doc_id, r, 2 + m % 3 AS n_cells, max(2 + m % 3) OVER (PARTITION BY doc_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS expected FROM l)
SELECT doc_id, CAST(r AS INTEGER) AS row_no, CAST(n_cells AS INTEGER) AS n_cells, CAST(expected AS INTEGER) AS expected FROM w WHERE n_cells < expected""")
def q46_ragged_rows(spark, sf_dir):
    """Rows with fewer cells than an earlier one of their table."""
    return tables.ragged_rows(tables.table_rows(_ragged_tables(spark, sf_dir))).drop("table_no")


@_query(f"""WITH {_LINES}, w AS (SELECT *, 2 + m % 3 AS cells, max(2 + m % 3) OVER (PARTITION BY doc_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS most FROM l),
f AS (SELECT doc_id, r, 'blank at 2' AS detail FROM w WHERE q % 10 = 0 UNION ALL SELECT doc_id, r, cells || ' of ' || most FROM w WHERE cells < most),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r, detail) AS rank, count(*) OVER (PARTITION BY doc_id) AS total FROM f)
SELECT doc_id, CAST(r AS INTEGER) AS row_no, detail, CAST(rank AS INTEGER) AS rank, CAST(total AS BIGINT) AS total, total > 3 AS incomplete FROM o WHERE rank <= 3""")
def q47_table_sanity(spark, sf_dir):
    """Blank and ragged rows in one capped listing with its flag."""
    return tables.table_sanity(_ragged_tables(spark, sf_dir), 3).where("category = 'cells'").select("doc_id", "row_no", "detail", "rank", "total", "incomplete")


_PLAIN = "abs(d - (a + b + c) / 3) > 0.005"
_GROUPED = "abs(d - ((a + b) / 2 + c) / 2) > 0.005"


@_query(f"""WITH {_LINES}, v AS (SELECT doc_id, max(q) FILTER (WHERE r = 1) AS a, max(q) FILTER (WHERE r = 2) AS b, max(q) FILTER (WHERE r = 3) AS c, max(q) FILTER (WHERE r = 4) AS d FROM l WHERE n >= 4 GROUP BY doc_id),
s AS (SELECT doc_id, 3 AS line_no, 'Alpha' AS row_label, 'Table 3' AS table_id, 'header_summary_mean' AS formula, d AS reported, (a + b + c) / 3 AS computed FROM v WHERE {_PLAIN}
  UNION ALL SELECT doc_id, 7, 'Gamma', 'Table 3', 'component_mean_of_means', d, ((a + b) / 2 + c) / 2 FROM v WHERE {_GROUPED}
  UNION ALL SELECT doc_id, 38, 'Delta', 'PDF table', 'component_mean_of_means', d, ((a + b) / 2 + c) / 2 FROM v WHERE {_GROUPED})
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, 'N' || row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS signal_id, row_label, table_id, formula, printf('%.2f', reported) AS reported_value,
  printf('%.2f', computed) AS visible_computed_value, {_TIER} AS gap_tier FROM s""")
def q48_line_states(spark, sf_dir):
    """Header, reset by a section, group tags, and a table line too far back."""
    cells = F.array_join(F.transform(F.slice("items", 1, 4), lambda i: T.number_text(i["l_quantity"], F.lit(2))), " ")
    row = lambda name: F.concat(F.lit(f"{name} "), cells)
    text = F.concat_ws("\n", F.lit("Table 3 Orders"), F.lit("Model Part Part Part Avg."), row("Alpha"), F.lit("Section 4 follows"), row("Beta"), F.lit("(DSRp) (DSRp) (DSRh)"), row("Gamma"), F.lit("\n".join(["filler"] * 30)), row("Delta"))
    found = tables.line_signals(_orders(spark, sf_dir, 4).select("doc_id", text.alias("text")))
    return found.select("doc_id", "line_no", "signal_id", "row_label", "table_id", "formula", "reported_value", "visible_computed_value", "gap_tier")


def _column_texts(spark, sf_dir) -> DataFrame:
    cells = F.array_join(F.transform(F.slice("items", 1, 4), lambda i: T.number_text(i["l_quantity"], F.lit(2))), " ")
    text = F.concat_ws("\n", F.lit("Table 7 Orders"), F.lit("Model Part Part Part Avg."), F.concat(F.lit("Alpha "), cells))
    return _orders(spark, sf_dir, 4).select("doc_id", text.alias("text"))


@_query(f"""WITH {_LINES}, v AS (SELECT doc_id, max(q) FILTER (WHERE r = 1) AS a, max(q) FILTER (WHERE r = 2) AS b, max(q) FILTER (WHERE r = 3) AS c, max(q) FILTER (WHERE r = 4) AS d FROM l WHERE n >= 4 GROUP BY doc_id)
SELECT doc_id, '1' AS signal_count, printf('%.2f', d) AS reported, '{tables.PAYLOAD_NOTE}' AS note FROM v WHERE {_PLAIN}""")
def q75_numeric_payload(spark, sf_dir):
    """The JSON object of a document's signals, read back."""
    payload = tables.numeric_payload(tables.line_signals(_column_texts(spark, sf_dir)))
    read = lambda path: F.get_json_object("json", path)
    return payload.select(read("$.input").cast("bigint").alias("doc_id"), read("$.signal_count").alias("signal_count"), read("$.signals[0].reported_value").alias("reported"), read("$.note").alias("note"))


@_query(f"""WITH {_LINES}, v AS (SELECT doc_id, max(q) FILTER (WHERE r = 1) AS a, max(q) FILTER (WHERE r = 2) AS b, max(q) FILTER (WHERE r = 3) AS c, max(q) FILTER (WHERE r = 4) AS d FROM l WHERE n >= 4 GROUP BY doc_id),
g AS (SELECT doc_id, d AS reported, (a + b + c) / 3 AS computed FROM v WHERE {_PLAIN})
SELECT doc_id, 'Signal (' || {_TIER} || ' gap' AS head, 'pp / ' || printf('%.2f', round(abs(reported - computed) / greatest(abs(computed), 1e-9) * 100, 4)) || '%): Table 7, line 3, row ''Alpha'': reported ' || printf('%.2f', reported) || '; mean of 3 cells = ' || printf('%.2f', computed) || '; delta ' || printf('%+.2f', reported - computed) AS rest FROM g""")
def q76_signal_sentences(spark, sf_dir):
    """Every signal as a sentence, without its absolute gap."""
    said = tables.line_signals(_column_texts(spark, sf_dir)).select("doc_id", tables.signal_sentence().alias("s"))
    return said.select("doc_id", F.regexp_extract("s", r"^(.*? gap) ", 1).alias("head"), F.regexp_extract("s", r"(pp / .*)$", 1).alias("rest"))


@_query("""SELECT p_partkey AS doc_id, CAST(v.line_no AS INTEGER) AS line_no, v.kind, CASE v.line_no WHEN 1 THEN 'Abstract' WHEN 3 THEN '2.1 The ' || p_name ELSE 'Figure 4: shows ' || p_type || ' parts' END AS value
FROM part, (VALUES (1, 'heading'), (3, 'heading'), (4, 'caption')) v(line_no, kind) WHERE v.line_no <> 3 OR p_size % 2 = 0""")
def q77_text_headings(spark, sf_dir):
    """headings and captions of extracted text."""
    third = F.concat(F.when(F.col("p_size") % 2 == 0, "2.1 The ").otherwise("2.1, the "), F.col("p_name"))
    text = F.concat_ws("\n", F.lit("Abstract"), F.lit("we say."), third, F.concat(F.lit("Figure 4: shows "), F.col("p_type"), F.lit(" parts")), F.lit("Table 5: short"))
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    found = signals.headings(docs).select("doc_id", "line_no", F.lit("heading").alias("kind"), F.col("heading").alias("value"))
    return found.unionByName(signals.scan(docs, "caption", signals.P.FIGURE_CAPTION).select("doc_id", "line_no", F.lit("caption").alias("kind"), "value"))


# --- LaTeX source -----------------------------------------------------------------------------------------------------


def _sources(spark, sf_dir) -> DataFrame:
    """Every part as a LaTeX source."""
    size, key = F.col("p_size"), _text("p_partkey")
    third, odd, fifth = size % 3 == 0, size % 2 != 0, size % 5 == 0
    lines = [
        F.concat(F.lit("\\documentclass[a]{c"), _text(size % 3), F.lit("}")),
        F.concat(F.lit("\\title{On {"), F.col("p_brand"), F.lit("}}")),
        F.concat(F.lit("\\author{A. \\emph{"), F.col("p_name"), F.lit("}\\thanks{n"), key, F.lit("@x.org}}")),
        F.concat(F.lit("\\begin{abstract}"), F.col("p_name"), F.lit(" words % not these\n here.\\end{abstract}")),
        F.concat(F.lit("\\section[s]{Intro} See \\ref{a,b} and \\cite[p]{k"), _text(size % 5), F.lit(", k1}\\citep{k1}.")),
        _when(third, "\\todo{fix} and ??", "plain \\% line % TODO hidden"),
        F.concat(F.lit("\\subsection*{About "), F.col("p_type"), F.lit("}")),
        F.concat(F.lit("\\caption{"), F.when(odd, F.concat(F.lit("A "), F.col("p_type"))).otherwise(F.lit("")), F.lit("}")),
        F.concat(F.lit("\\newcommand{\\foo}{x} \\renewcommand{\\foo}{x"), _when(odd, "y"), F.lit("} \\def\\bar{z}")),
        F.concat(F.lit("\\begin{equation}\\foo + \\epsilon"), _when(third, " + \\varepsilon"), _when(fifth, " + \\mystery"), F.lit("\\end{equation}")),
        F.concat(F.lit("\\[ \\alpha"), _when(fifth, "\\mystery"), F.lit(" \\]")),
        F.concat(F.lit("mail u"), key, F.lit("@example.com, ORCID: 0000-0001-2345-678X, /home/u"), _text(size % 7), F.lit(" https://github.com/o/r"), _when(third, " \\cameraready")),
    ]
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))


@_query("""SELECT p_partkey AS doc_id, c.category, CAST(c.ord AS INTEGER) AS ord, c.label, CASE c.category || c.ord WHEN 'documentclass0' THEN 'c' || p_size % 3 WHEN 'title0' THEN 'On ' || p_brand
  WHEN 'abstract0' THEN p_name || ' words here.' WHEN 'section0' THEN 'Intro' WHEN 'section1' THEN 'About ' || p_type ELSE CASE WHEN p_size % 2 <> 0 THEN 'A ' || p_type ELSE '' END END AS value
FROM part, (VALUES ('documentclass', 0, NULL), ('title', 0, NULL), ('abstract', 0, NULL), ('section', 0, 'section'), ('section', 1, 'subsection'), ('caption', 0, NULL)) c(category, ord, label)""")
def q49_latex_commands(spark, sf_dir):
    """sections with their level, captions, title, abstract and class."""
    return signals.commands(_sources(spark, sf_dir))


@_query(r"""SELECT p_partkey AS doc_id, 'On ' || p_brand AS title, CAST(len(regexp_extract_all(p_name, '[\p{L}\p{N}_]+')) + 2 AS BIGINT) AS abstract_words, 2 AS refs, 3 AS cites, CASE WHEN p_size % 5 = 1 THEN 1 ELSE 2 END AS distinct_cites FROM part""")
def q50_title_and_keys(spark, sf_dir):
    """the first title, the abstract's words, references and citations."""
    docs = _sources(spark, sf_dir)
    return signals.title_and_abstract(docs).join(signals.key_counts(docs), "doc_id")


@_query("""SELECT p_partkey AS doc_id, 'todo' AS category, 6 AS line_no, '\\todo{fix}' AS value FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, 'placeholder', 7, '??' FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'todo', 7, 'TODO' FROM part WHERE p_size % 3 <> 0
UNION ALL SELECT p_partkey, 'documentclass', 1, '\\documentclass[a]{c' || p_size % 3 || '}' FROM part""".replace("\\\\", "\\").replace("6 AS line_no", "7 AS line_no"))
def q51_text_signals(spark, sf_dir):
    """F8, F9 and the other line-numbered scans, over raw text as it stands."""
    return signals.text_signals(_sources(spark, sf_dir))


@_query("""SELECT p_partkey AS doc_id, 0 AS eq_no, 'equation 1' AS label, '\\foo + \\epsilon' || CASE WHEN p_size % 3 = 0 THEN ' + \\varepsilon' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ' + \\mystery' ELSE '' END AS body FROM part
UNION ALL SELECT p_partkey, 1, 'display math 1', ' \\alpha' || CASE WHEN p_size % 5 = 0 THEN '\\mystery' ELSE '' END || ' ' FROM part""".replace("\\\\", "\\"))
def q52_equations(spark, sf_dir):
    """Named environments, then display math."""
    return symbols.equations(_sources(spark, sf_dir))


@_query("""SELECT p_partkey AS doc_id, v.name, CAST(v.ord AS INTEGER) AS ord, CASE v.ord WHEN 0 THEN 'x' WHEN 1 THEN CASE WHEN p_size % 2 <> 0 THEN 'xy' ELSE 'x' END ELSE 'z' END AS expansion FROM part, (VALUES ('foo', 0), ('foo', 1), ('bar', 2)) v(name, ord)""")
def q53_macros(spark, sf_dir):
    """definitions, one syntax after the other."""
    return symbols.macros(_sources(spark, sf_dir))


@_query("""WITH s AS (SELECT p_partkey AS doc_id, '1 redefined' AS kind, 'foo' AS subject, 'x; xy' AS detail FROM part WHERE p_size % 2 <> 0
  UNION ALL SELECT p_partkey, '2 unknown', 'mystery', 'equation 1, display math 1' FROM part WHERE p_size % 5 = 0
  UNION ALL SELECT p_partkey, '3 variants', 'epsilon', 'varepsilon' FROM part WHERE p_size % 3 = 0)
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind) AS INTEGER) AS ord, CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS total, false AS incomplete FROM s""")
def q54_symbol_signals(spark, sf_dir):
    """Redefined macros, unknown commands, pairs of glyph variants."""
    return symbols.symbol_signals(_sources(spark, sf_dir))


@_query("""WITH s AS (SELECT p_partkey AS doc_id, 1 AS o, 'email' AS category, 'n' || p_partkey || '@x.org' AS value FROM part UNION ALL SELECT p_partkey, 2, 'email', 'u' || p_partkey || '@example.com' FROM part
  UNION ALL SELECT p_partkey, 3, 'github', 'https://github.com/o/r' FROM part UNION ALL SELECT p_partkey, 4, 'path', '/home/u' || p_size % 7 FROM part
  UNION ALL SELECT p_partkey, 5, 'author', 'A. ' || p_name FROM part UNION ALL SELECT p_partkey, 6, 'thanks', 'n' || p_partkey || '@x.org' FROM part
  UNION ALL SELECT p_partkey, 7, 'orcid', '0000-0001-2345-678X' FROM part UNION ALL SELECT p_partkey, 8, 'final_switch', '\\cameraready' FROM part WHERE p_size % 3 = 0)
SELECT doc_id, category, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS INTEGER) AS rank, value FROM s""".replace("\\\\", "\\"))
def q55_identity(spark, sf_dir):
    """Identity signals in their fixed order."""
    return signals.identity(_sources(spark, sf_dir))


@_query(r"""SELECT p_partkey AS doc_id, md5(replace('# TITLE: On ' || p_brand || '~~## SECTION: x~See and~a 100\% b~ ~- one ' || p_name || ' ~~[figure]~~CAPTION: ' || p_type, '~', chr(10))) AS digest FROM part""")
def q56_plain_text(spark, sf_dir):
    """A source as readable text."""
    source = F.concat(F.lit("\\title{On {"), F.col("p_brand"), F.lit("}}\n\\section{x}See \\foo{y}and% gone\na 100\\% b\n\\begin{itemize}\\item one \\textbf{"), F.col("p_name"), F.lit("}\\end{itemize}\n\\begin{figure}\n\\caption{"), F.col("p_type"), F.lit("}\n\\end{figure}\n"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.md5(F.encode(T.plain_text(source), "UTF-8")).alias("digest"))


@_query(r"""SELECT p_partkey AS doc_id, 'a ' || p_name || ' b' AS snippet, 'a b ' || p_type AS line, 'a ' || chr(10) || '\% ' || p_brand || ' \\' || chr(10) || '\begin{verbatim}' || chr(10) || 'x % y' || chr(10) || '\end{verbatim}' AS code FROM part""")
def q57_comments(spark, sf_dir):
    """Comments, one line, snippets."""
    code = F.concat(F.lit("a % b\n\\% "), F.col("p_brand"), F.lit(" \\\\% d\n\\begin{verbatim}\nx % y\n\\end{verbatim}"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), T.snippet(F.concat(F.lit(" a  "), F.col("p_name"), F.lit("% c\n b"))).alias("snippet"), T.one_line(F.concat(F.lit("\\emph{a}\\cite[p]  {b}% c\n "), F.col("p_type"))).alias("line"), T.strip_comments(code).alias("code"))


@_query(r"""WITH p AS (SELECT p_partkey AS doc_id, len(regexp_extract_all(p_name, '[\p{L}\p{N}_]+')) AS w, p_size FROM part),
s AS (SELECT doc_id, 1 AS section_no, 'Intro' AS title, w + 3 AS n_words, 1 AS n_cites FROM p WHERE p_size % 2 = 0 UNION ALL SELECT doc_id, 2, '2 Results', 3 * w, 0 FROM p WHERE p_size % 2 = 0
  UNION ALL SELECT doc_id, 0, 'Whole extracted text', w + 2, 0 FROM p WHERE p_size % 2 <> 0)
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, title, CAST(n_words AS BIGINT) AS n_words, CAST(n_cites AS BIGINT) AS n_cites, printf('%.1f', n_cites / CAST(n_words AS DOUBLE) * 1000) AS density FROM s""")
def q58_section_words(spark, sf_dir):
    """Words and citations of every section, or of a text without any."""
    name = F.col("p_name")
    headed = F.concat(F.lit("front\n# Intro\n"), name, F.lit(" as shown [12]\n2 Results\n"), name, F.lit(" "), name, F.lit(" "), name, F.lit("\n"))
    text = F.when(F.col("p_size") % 2 == 0, headed).otherwise(F.concat(name, F.lit(", no headings")))
    return signals.section_word_stats(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


@_query("""WITH b AS (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size % 3 = 0) AS u, count(*) FILTER (WHERE p_size % 2 = 0) AS a, count(*) FILTER (WHERE p_size % 7 = 0) AS d FROM part GROUP BY 1),
s AS (SELECT p_brand, 'field_presence' AS kind, 'url ' || u || '/' || n AS detail FROM b WHERE u > 0 AND u < n
  UNION ALL SELECT p_brand, 'entry_types', 'article=' || a || ', inproceedings=' || n - a FROM b WHERE a > 0 AND a < n
  UNION ALL SELECT p_brand, 'page_separators', 'double-dash=' || n - d || ', single-dash=' || d FROM b WHERE d > 0 AND d < n)
SELECT * FROM s UNION ALL SELECT p_brand, 'none', NULL FROM b WHERE p_brand NOT IN (SELECT p_brand FROM s)""")
def q59_style_drift(spark, sf_dir):
    """What is mixed in the bibliography of a brand."""
    odd = F.col("p_size") % 2 != 0
    text = F.concat(F.lit("@"), _when(odd, "InProceedings{k", "article{k"), _text("p_partkey"), F.lit(", title={T}, pages={1"), _when(F.col("p_size") % 7 == 0, "-", "--"), F.lit("9}"), _when(F.col("p_size") % 3 == 0, ", url={u}"), F.lit("}\n"))
    docs = _t(spark, sf_dir, "part").select(F.struct("p_brand", "p_partkey").alias("doc_id"), text.alias("text"))
    entries = bibliography.entries(docs).withColumn("p_brand", F.col("doc_id.p_brand"))
    return bibliography.style_drift(entries, "p_brand")


@_query("""WITH f AS (SELECT p_partkey AS doc_id, p_size AS s, p_name, p_type FROM part),
r AS (SELECT doc_id, '00 class' AS section, 1 AS ord, 'c' || s % 3 AS item FROM f
  UNION ALL SELECT doc_id, '02 sections', 1, 'section: Intro' FROM f UNION ALL SELECT doc_id, '02 sections', 2, 'subsection: About ' || p_type FROM f
  UNION ALL SELECT doc_id, '03 captions', 1, CASE WHEN s % 2 <> 0 THEN 'A ' || p_type ELSE 'empty caption' END FROM f
  UNION ALL SELECT doc_id, '07 keys', 1, 'refs 2, cites 3, distinct ' || CASE WHEN s % 5 = 1 THEN 1 ELSE 2 END FROM f
  UNION ALL SELECT doc_id, '09 placeholders', 1, 'line 7: ??' FROM f WHERE s % 3 = 0)
SELECT doc_id, section, CAST(ord AS INTEGER) AS ord, item FROM r""")
def q60_latex_summary(spark, sf_dir):
    """The assembled summary, those of its sections that are stated by the table."""
    wanted = ["00 class", "02 sections", "03 captions", "07 keys", "09 placeholders"]
    return signals.summary(_sources(spark, sf_dir), "latex").where(F.col("section").isin(wanted))


# --- projects ---------------------------------------------------------------------------------------------------------


def _project_files(spark, sf_dir) -> DataFrame:
    """Every customer as a project: a main file, a paper and a supplement, each standalone by remainders."""
    key = F.col("c_custkey")
    root = F.concat(F.lit("/p"), _text(key))
    made = F.array(*[F.struct(F.concat(root, F.lit(name)).alias("path"), _when(alone, "\\documentclass{a}\\begin{document}", "part").alias("text")) for name, alone in (("/main.tex", key % 2 == 0), ("/deep/er/paper.tex", key % 3 == 0), ("/supp.tex", key % 5 == 0))])
    return _t(spark, sf_dir, "customer").select(root.alias("root"), F.explode(made).alias("f")).select("root", "f.path", "f.text")


@_query("""WITH f AS (SELECT '/p' || c_custkey AS root, v.name, v.score, v.depth, CASE v.name WHEN '/main.tex' THEN c_custkey % 2 = 0 WHEN '/deep/er/paper.tex' THEN c_custkey % 3 = 0 ELSE c_custkey % 5 = 0 END AS alone
  FROM customer, (VALUES ('/main.tex', -120, 1), ('/deep/er/paper.tex', -100, 3), ('/supp.tex', 10, 1)) v(name, score, depth)),
r AS (SELECT *, count(*) FILTER (WHERE alone) OVER (PARTITION BY root) AS c, row_number() OVER (PARTITION BY root ORDER BY alone DESC, score, depth, name) AS i FROM f)
SELECT root, root || name AS path, CAST(CASE WHEN c > 0 THEN c - 1 ELSE 0 END AS BIGINT) AS others FROM r WHERE c = 0 OR i = 1""")
def q61_entry_files(spark, sf_dir):
    """The entry of every project, or all of its files where none stands alone."""
    return projects.entry_files(_project_files(spark, sf_dir)).select("root", "path", F.col("others").cast("bigint").alias("others"))


@_query("""SELECT '/w' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '/src/a.tex' WHEN 1 THEN '/x/a.tex' WHEN 2 THEN '/y/a.tex' ELSE '/z/a.tex' END AS path,
  '/w' || c_custkey || CASE c_custkey % 4 WHEN 3 THEN '/z' ELSE '' END AS root FROM customer""")
def q62_project_roots(spark, sf_dir):
    """The root above a container, beside a marker, beside resources, or the file's own directory."""
    key = F.col("c_custkey")
    base = F.concat(F.lit("/w"), _text(key))
    entry = lambda name, is_dir: F.struct(F.concat(base, F.lit(name)).alias("path"), F.lit(is_dir).alias("is_dir"))
    kinds = F.when(key % 4 == 0, F.array(entry("/src/a.tex", False))).when(key % 4 == 1, F.array(entry("/x/a.tex", False), entry("/Makefile", False))).when(key % 4 == 2, F.array(entry("/y/a.tex", False), entry("/figures", True))).otherwise(F.array(entry("/z/a.tex", False)))
    listing = _t(spark, sf_dir, "customer").select(F.explode(kinds).alias("e")).select("e.path", "e.is_dir")
    return projects.project_roots(listing).where(F.endswith("path", F.lit(".tex")))


@_query("""SELECT '/c' || c_custkey || '/f.tex' AS src, CAST(v.ord AS INTEGER) AS ord, CASE v.ord WHEN 0 THEN '/c' || c_custkey || '/s/g.tex' WHEN 1 THEN '/out.tex' ELSE '/c' || c_custkey || '/lost' END AS dst,
  CASE v.ord WHEN 0 THEN 'ok' WHEN 1 THEN 'outside' ELSE 'missing' END AS status FROM customer, (VALUES (0), (1), (2)) v(ord)""")
def q63_include_edges(spark, sf_dir):
    """Includes in order, guarded against leaving the project."""
    base = F.concat(F.lit("/c"), _text("c_custkey"))
    files = _t(spark, sf_dir, "customer").select(base.alias("root"), F.explode(F.array(F.struct(F.concat(base, F.lit("/f.tex")).alias("path"), F.lit("a \\input{s/g} \\import{../}{out.tex} \\include{lost} z").alias("text")), F.struct(F.concat(base, F.lit("/s/g.tex")).alias("path"), F.lit("inner").alias("text")))).alias("f"))
    return projects.include_edges(files.select("root", "f.path", "f.text")).select("src", "ord", "dst", "status")


@_query("""SELECT '/c' || c_custkey || '/0.tex' AS root, 'a b' || c_custkey || ' c d' || CASE WHEN c_custkey % 2 = 0 THEN ' tail' ELSE '' END AS text FROM customer""")
def q64_expanded(spark, sf_dir):
    """Every project's text with its includes inlined once, in reading order."""
    key, base = F.col("c_custkey"), F.concat(F.lit("/c"), _text("c_custkey"))
    made = [("/0.tex", F.concat(F.lit("a \\input{1} \\input{2}"), _when(key % 2 == 0, " \\input{3}"))), ("/1.tex", F.concat(F.lit("b"), _text(key), F.lit(" \\input{2}"))), ("/2.tex", F.lit("c \\input{0} d")), ("/3.tex", F.lit("tail \\input{1}"))]
    files = _t(spark, sf_dir, "customer").select(base.alias("root"), F.explode(F.array(*[F.struct(F.concat(base, F.lit(name)).alias("path"), text.alias("text")) for name, text in made])).alias("f")).select("root", "f.path", "f.text")
    roots = files.where(F.endswith("path", F.lit("/0.tex"))).select(F.col("path").alias("root"))
    out = projects.expanded(files, projects.include_edges(files), roots)
    return out.select("root", T.compact(F.col("text")).alias("text"))


@_query("""SELECT '/p' || c_custkey AS root, '/p' || c_custkey || '/' || v.name AS path, CAST(v.ord AS INTEGER) AS ord, v.status FROM customer, (VALUES ('a.bib', 0, 'ok', 0), ('b.bib', 1, 'missing', 0), ('a.bib', 0, 'fallback', 1), ('z.bib', 1, 'fallback', 1)) v(name, ord, status, odd) WHERE c_custkey % 2 = v.odd""")
def q65_bibliographies(spark, sf_dir):
    """Named bibliographies, or the project's own where no command names any."""
    root = F.concat(F.lit("/p"), _text("c_custkey"))
    customers = _t(spark, sf_dir, "customer").select(root.alias("root"), _when(F.col("c_custkey") % 2 == 0, "\\bibliography{a, b}").alias("text"))
    listing = customers.select("root", F.explode(F.array(F.concat("root", F.lit("/a.bib")), F.concat("root", F.lit("/z.bib")))).alias("path"))
    return projects.bibliographies(customers.select("root", F.concat("root", F.lit("/m.tex")).alias("path"), "text"), listing)


# --- extensions -------------------------------------------------------------------------------------------------------


@_query("""SELECT lang AS scope, source AS unit, CAST(sum(n_chars) AS BIGINT) AS total, CAST(count(quality) AS BIGINT) AS reviewed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def x04_coverage_totals(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("lang").alias("scope"), F.col("source").alias("unit"), F.col("n_chars").alias("total"), F.col("quality").isNotNull().cast("bigint").alias("reviewed"))
    return extensions.coverage_totals(rows, "scope", "unit", "total", "reviewed").select("scope", "unit", F.col("total").cast("bigint").alias("total"), F.col("reviewed").cast("bigint").alias("reviewed"))


@_query("""SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS urgent, CAST(count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS BIGINT) AS low FROM orders GROUP BY 1""")
def x05_severity_counts(spark, sf_dir):
    out = extensions.severity_counts(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "5-LOW"])
    return out.select("o_custkey", F.col("`1-URGENT`").alias("urgent"), F.col("`5-LOW`").alias("low"))


@_query("""SELECT o_orderkey, 'my_paper_v' || o_custkey || '_' || strftime(o_orderdate, '%Y-%m-%d') AS name FROM orders""")
def x06_dated_name(spark, sf_dir):
    path = F.concat(F.lit("/x/my paper+v"), _text("o_custkey"), F.lit(".pdf"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", extensions.dated_name(path, F.col("o_orderdate")).alias("name"))


@_query("""WITH t AS (SELECT l_orderkey, l_returnflag, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, max(q) AS base FROM t WHERE l_returnflag = 'N' GROUP BY 1)
SELECT l_orderkey, l_returnflag, printf('%.4f', (q - base) / CAST(base AS DOUBLE)) AS gain FROM t LEFT JOIN b USING (l_orderkey)""")
def x01b_relative_gains(spark, sf_dir):
    totals = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("q"))
    return extensions.relative_gains(totals, "l_orderkey", "l_returnflag", "q", "N").select("l_orderkey", "l_returnflag", T.number_text(F.col("gain"), F.lit(4)).alias("gain"))


@_query("""WITH t AS (SELECT l_suppkey, l_returnflag, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL), m AS (SELECT *, max(q) OVER (PARTITION BY l_suppkey) AS best FROM t)
SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS wins FROM m WHERE q = best GROUP BY 1""")
def x01c_win_counts(spark, sf_dir):
    totals = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    return extensions.win_counts(totals, "l_suppkey", "l_returnflag", "q")


@_query("""SELECT l_orderkey, CAST(sum(CAST(l_discount * 100 AS DECIMAL(18,6))) AS VARCHAR) AS total FROM lineitem GROUP BY 1 HAVING abs(sum(CAST(l_discount * 100 AS DECIMAL(18,6))) - 100) > 80""")
def x08b_percent_sums(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 100).alias("share"))
    return extensions.percent_sums(rows, ["l_orderkey"], "share", 80).select("l_orderkey", F.col("total").cast("string").alias("total"))
