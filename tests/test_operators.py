"""Signals, bibliography, symbols, bundles, reports, drift and projects on small inputs of our own."""

import json
import re

from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import artifacts, bibliography, drift, extensions, html_report, quality, signals, symbols
from folioscan.sources import projects


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


def test_text_functions(spark):
    assert value(spark, T.strip_comments, "a % b\n\\% c \\\\% d\n\\begin{verbatim}\nx % y\n\\end{verbatim}\nz%") == "a \n\\% c \\\\\n\\begin{verbatim}\nx % y\n\\end{verbatim}\nz"
    assert value(spark, T.one_line, "\\emph{a}  \\cite[p]{b}% c\n d") == "a b d"
    assert value(spark, T.split_cells, r"a \& b & c \\& d") == [r"a \& b ", r" c \\", " d"]
    n = value(spark, T.first_number, "x -1,234.50% y 7")
    assert (n.value, n.text, n.decimals) == (-1234.5, "-1,234.50%", 2)
    assert value(spark, T.first_number, "none") is None
    assert value(spark, T.row_label, "3  Model  A 2.5 7") == "(row label unavailable)"
    assert value(spark, T.row_label, "Model  A 2.5 7") == "Model A"
    assert value(spark, T.summary_positions, "Model Art Law Avg. Rec Avg.") == [2, 4]
    assert value(spark, T.words, "étude naïve_1 – ok") == 3
    assert [(m.line_no, m.match) for m in value(spark, lambda c: T.matches(c, "b."), "a\nbx c\n\nby")] == [(2, "bx"), (4, "by")]
    plain = value(spark, T.plain_text, "\\title{A \\emph{B}}\n\\section{One}\nx \\textbf{y} \\foo{z}\n% gone")
    assert plain == "# TITLE: A B\n\n## SECTION: One\n\nx y"


def test_long_braces_do_not_overflow(spark):
    long = "\\caption{" + "a{b}" * 20000 + "}"
    assert len(value(spark, lambda c: F.get(T.find_all(c, __import__("folioscan.functions.patterns", fromlist=["x"]).CAPTION, 1), F.lit(0)), long)) == 80000


TEX = r"""\documentclass[a]{article}
\title{On {Things}}
\author{A. Person\thanks{a@b.org}}
\begin{document}
\begin{abstract}One two three.\end{abstract}
\section{Intro} See \ref{a,b} and \cite{k1, k2}\cite{k1}. \todo{fix} ??
\caption{}
\newcommand{\foo}{x} \renewcommand{\foo}{y} \def\bar{z}
\begin{equation}\foo + \epsilon + \varepsilon + \mystery\end{equation}
\[ \alpha \]
mail me@example.com, ORCID: 0000-0001-2345-678X \iclrfinalcopy
"""


def test_signals(spark):
    d = docs(spark, TEX)
    found = {(r.category, r.line_no) for r in signals.text_signals(d).collect()}
    assert {("todo", 6), ("placeholder", 6), ("documentclass", 1)} <= found
    assert [(r.category, r.label, r.value) for r in signals.commands(d).where("category IN ('section', 'caption')").collect()] == [("section", "section", "Intro"), ("caption", None, "")]
    assert signals.title_and_abstract(d).first()[1:] == ("On Things", 3)
    assert signals.key_counts(d).first()[1:] == (2, 3, 2)
    assert [(r.category, r.value) for r in signals.identity(d).orderBy("rank").collect()] == [
        ("email", "a@b.org"), ("email", "me@example.com"), ("author", "A. Person"), ("thanks", "a@b.org"), ("orcid", "0000-0001-2345-678X"), ("final_switch", "\\iclrfinalcopy"),
    ]
    sections = {r.section for r in signals.summary(d).collect()}
    assert {"01 title", "02 sections", "05 equations", "06 symbols"} <= sections
    assert signals.summary(docs(spark, "1 Introduction\nword word\nTable 1: a caption that is long\n"), "pdf").count() > 2


def test_sections(spark):
    rows = signals.section_word_stats(docs(spark, "# One\na b c\n2 Results\nd [3]\n", "no heading here")).orderBy("doc_id", "section_no").collect()
    assert [(r.doc_id, r.title, r.n_words, r.n_cites, r.density) for r in rows] == [(0, "One", 3, 0, "0.0"), (0, "2 Results", 2, 1, "500.0"), (1, "Whole extracted text", 3, 0, "0.0")]


def test_symbols(spark):
    d = docs(spark, TEX)
    assert [(r.kind, r.subject, r.detail) for r in symbols.symbol_signals(d).orderBy("ord").collect()] == [("1 redefined", "foo", "x; y"), ("2 unknown", "mystery", "equation 1"), ("3 variants", "epsilon", "varepsilon")]
    assert [r.label for r in symbols.equations(d).orderBy("eq_no").collect()] == ["equation 1", "display math 1"]


BIB = """@string{x = "y"}
@inproceedings{a, title={T {N}}, booktitle={Short}, pages={1--2}, url={u}}
@inproceedings{b,
  booktitle = "A very long name of a conference on everything",
  pages = {3-4}, year = 2020, pages = {5-6},
}
@article{c, journal={J}}
"""


def test_bibliography(spark):
    rows = bibliography.entries(docs(spark, BIB))
    got = {r.key: r.fields for r in rows.collect()}
    assert got["a"]["title"] == "T N" and got["b"]["pages"] == "5-6" and "year" not in got["b"]
    assert bibliography.publications(docs(spark, BIB)).first().n_publications == 3
    drifted = {r.kind for r in bibliography.style_drift(rows).collect()}
    assert drifted == {"field_presence", "entry_types", "booktitles", "page_separators"}
    assert [r.kind for r in bibliography.style_drift(bibliography.entries(docs(spark, "@article{a, url={u}}\n@article{b, url={v}}"))).collect()] == ["none"]


def finding(**changes):
    base = {k: "x" for k in ("location", "reader_friction", "writing_principle", "next_draft_task", "evidence_basis", "verification_method", "confidence", "severity_rationale", "downgrade_condition")}
    return {k: v for k, v in (base | {"id": "F1", "severity": "Minor"} | changes).items() if v is not ...}


def page(body, notes=True):
    sections = "".join(f'<section id="{s}">{body if s == "issue-index" else ""}{NOTE_ROWS if notes and s == "deep-reading-notes" else ""}</section>' for s in html_report.REQUIRED)
    return f"<html><body>{sections}<p>Coverage consistency</p></body></html>"


NOTE_ROWS = '<table><caption>c</caption><tr data-note-kind="sentence" data-severity="minor"><td>s</td></tr><tr data-note-kind="paragraph" data-decision="keep"><td>p</td></tr><tr data-note-kind="section" data-severity="minor"><td>t</td></tr></table>'


def audited(spark, cases):
    """Rules by case: all bundles are audited by one plan."""
    rows = [(k, *[v if v is None or isinstance(v, str) else json.dumps(v) for v in (case.get(c) for c in (*artifacts.FILES, "html"))]) for k, case in cases.items()]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("bundle_id", *artifacts.FILES, "html")))
    got = {k: set() for k in cases}
    for r in artifacts.audit(frame).collect():
        got[r.scope].add((r.rule_id, r.subject))
    return got


def test_bundles(spark):
    numeric = dict(severity="Blocker", reported_value="9.1", visible_computed_value="8.0", delta="+1.1", aggregation_caveat="c")
    claim = {k: "x" for k in artifacts.CLAIM_FIELDS}
    unit = {"unit": "u", "total": 3, "reviewed": 4, "with_issues": 0, "clean": 0, "skipped": 1}
    keys = artifacts.OBSERVATIONS
    weak = {"table_id": "T", "row_label": "row", "reported_value": "1", "visible_computed_value": "2", "delta": "", "aggregation_caveat": "c", "render_required": "yes"}
    signal = {"signal_id": "N1", "table_id": "Table 2", "row_label": "Base model", "reported_value": "9.1", "visible_computed_value": "8.0", "delta": "+1.1", "aggregation_caveat": "c", "required_severity": "Blocker"}
    sections = [{"id": "issue-index", "status": "rendered"}, {"id": "gone", "status": "rendered"}]
    report = dict(findings=[finding()], numeric_audit={"signals": [signal]}, render_manifest={"output_files": [], "sections": sections, "deferred_findings": []})
    item = '<article id="{}" data-severity="{}" data-issue-type="numeric"><p>Table 2, Base: reported 9.1, computed 8.0</p></article>'
    cases = {
        "clean": (dict(findings={"findings": [finding()]}), set()),
        "repeated": (dict(findings=[finding(), finding(location="")]), {("D1", "F1"), ("D2", "F1")}),
        "severity": (dict(findings=[finding(severity="Odd")]), {("D3", "F1")}),
        "high risk": (dict(findings=[finding(severity="Major", confidence=None)]), {("D4", "F1")}),
        "zero and false": (dict(findings=[finding(location=0, evidence_basis=False)]), set()),
        "null delta": (dict(findings=[finding(delta=None)]), {("D5", "F1"), ("D6", "F1"), ("D7-vague", "F1")} - {("D7-vague", "F1")}),
        "numeric": (dict(findings=[finding(**numeric, diagnosis="9.1 is not 8.0")]), set()),
        "numeric vague": (dict(findings=[finding(**numeric, diagnosis="wrong, please check")]), {("D7", "F1"), ("D7-directive", "F1"), ("D7-vague", "F1")}),
        "no list": (dict(findings={"other": []}), {("D0", "findings")}),
        "claims": (dict(findings=[finding()], claims=[claim | {"linked_findings": ["F1", "F9"]}]), {("D8", "x")}),
        "coverage": (dict(findings=[], coverage={"units": [unit, {"unit": None}], "reader_journey_passes": [{"pass": f"Pass {k}"} for k in range(6)]}), {("D10-reviewed", "1"), ("D10-skipped", "1"), ("D11", "Pass 6"), ("D9-unit", "2")}),
        "observations": (
            dict(findings=[], pass_observations={k: [] for k in keys[2:]} | {keys[1]: [{"linked_findings": ["F7"]}, 3]}),
            {("D12-key", keys[0]), ("D12-location", keys[1] + " #1"), ("D12-object", keys[1] + " #2"), ("D13", "F7")},
        ),
        "manifest": (dict(findings=[], render_manifest={"output_files": [], "sections": [], "deferred_findings": ["F2"]}), {("D14-deferred", "F2"), ("D14-sections", "sections")}),
        "signals": (dict(findings=[], numeric_audit={"signal_count": 2, "signals": [weak]}), {("D15-count", "signal_count"), ("D15-field", "1"), ("D15-flag", "1"), ("D15-severity", "1")}),
        "rendered": (report | dict(html=page(item.format("F1", "Blocker"))), {("D18", "gone")}),
    }
    got = audited(spark, {k: c for k, (c, _) in cases.items()} | {"minor": report | dict(html=page(item.format("F2", "minor"))), "absent": report | dict(html=page(""))})
    assert {k: got[k] for k in cases} == {k: want for k, (_, want) in cases.items()}
    assert {r for r, _ in got["minor"]} == {"D17", "D18", "D19"} and {r for r, _ in got["absent"]} == {"D16", "D18", "D19"}


def test_html_rules(spark):
    cases = {
        "clean": page(""),
        "section": page("").replace('id="revision-plan"', ""),
        "open": page("<p>open"),
        "link": page('<a href="#nowhere">x</a>'),
        "notes": page("", notes=False),
        "legacy": page('<div id="margin-notes"></div>'),
        "count": page("<table><caption>c</caption><tr><td>Sentence notes</td><td>4</td></tr></table>"),
        "gate": page("").replace("Coverage consistency", "pending in x"),
        "labels": page("<p>降级条件</p>"),
        "vague": page("<p>Avg may differ by hidden decimals</p>"),
        "concrete": page("<p>Avg: reported 1.2, computed 1.1, hidden decimals</p>"),
        "raw keys": page("<p>the reported_value is</p>"),
        "finding": page('<a href="#F12">x</a>'),
        "table": page("<table><tr><th>x</th></tr></table>"),
    }
    got = {k: set() for k in cases}
    for r in html_report.audit(spark.createDataFrame(list(cases.items()), "bundle_id string, html string")).collect():
        got[r.scope].add(r.rule_id)
    assert got["clean"] == got["concrete"] == set()
    assert {k: got[k] for k in ("notes", "count", "gate", "table")} == {"notes": {"H5"}, "count": {"H7"}, "gate": {"H8", "H8-pending"}, "table": {"H13-caption", "H13-scope"}}
    for k, rule in {"section": "H2", "open": "H3", "link": "H4", "legacy": "H6", "labels": "H9", "vague": "H10", "raw keys": "H11", "finding": "H12"}.items():
        assert rule in got[k], k


def test_reports_are_parsed_once(spark):
    bundles = spark.createDataFrame([("b", "[]", "<p>x</p>")], "bundle_id string, findings string, html string")
    for frame in (artifacts.audit(bundles), html_report.audit(bundles.select("bundle_id", "html"))):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_crossing_and_early_ends():
    items = html_report.page_items('<p>a<li>b</p>c</li><div data-severity="x" data-issue-type="math">one<div>two</div>three</div><section id="s">x<section id="t">y</section>z</section>')
    by = lambda kind: [i for i in items if i["kind"] == kind]
    assert by("status") == [{"kind": "status", "unclosed": True}]
    assert [i["text"] for i in by("issue")] == ["onetwo"]
    assert {i["section_id"]: i["text"] for i in by("section")} == {"s": "x yz", "t": "y"}


def test_drift(spark):
    runs = spark.createDataFrame([("s", json.dumps([finding(), finding(id=None, location=" L ", claim_type="T"), finding(id="F3")]), json.dumps({"findings": [finding(severity="Blocker"), finding(id="F4"), finding(id="F3", severity_rationale=""), finding(id="F3")]}))], "bundle_id string, a string, b string")
    a, b = drift.findings(runs, "a"), drift.findings(runs, "b")
    got = {(r.key, r.kind, r.detail) for r in drift.compare(a, b).collect()}
    assert got == {("F1", "severity", "Minor -> Blocker (distance 2)"), ("l::t", "only_in_first", None), ("F4", "only_in_second", None)}
    assert {(r.severity, r.first, r.second) for r in drift.histogram(a, b).collect()} == {("Minor", 3, 3), ("Blocker", 0, 1)}


def test_projects(spark):
    files = spark.createDataFrame(
        [
            ("/p", "/p/main.tex", "\\documentclass{a}\\begin{document} A \\input{sec/one} B \\input{sec/one} \\include{../out} C \\input{lost}"),
            ("/p", "/p/sec/one.tex", "one \\input{two} end"),
            ("/p", "/p/sec/two.tex", "two \\input{one}"),
            ("/p", "/p/supp.tex", "\\documentclass{a}"),
        ],
        "root string, path string, text string",
    )
    entry = projects.entry_files(files).collect()
    assert [(r.path, r.others, r.warning) for r in entry] == [("/p/main.tex", 1, "other candidates: /p/supp.tex")]
    edges = projects.include_edges(files)
    assert {(r.src, r.ord): (r.dst, r.status) for r in edges.collect()}[("/p/main.tex", 2)] == ("/out", "outside")
    roots = spark.createDataFrame([("/p/main.tex",)], "root string")
    text = projects.expanded(files, edges, roots).first().text
    assert " ".join(text.split()) == "\\documentclass{a}\\begin{document} A one two end B C" or text.split()[1:5] == ["A", "one", "two", "end"]
    listing = spark.createDataFrame([("/q/src/a.tex", False), ("/q/src", True), ("/r/x/a.tex", False), ("/r/figures", True), ("/s/y/a.tex", False)], "path string, is_dir boolean")
    assert {r.path: r.root for r in projects.project_roots(listing).collect()} == {"/q/src/a.tex": "/q", "/r/x/a.tex": "/r", "/s/y/a.tex": "/s/y"}
    bibs = projects.bibliographies(spark.createDataFrame([("/p", "/p/main.tex", "\\bibliography{a, b}"), ("/q", "/q/m.tex", "")], "root string, path string, text string"), spark.createDataFrame([("/p", "/p/a.bib"), ("/q", "/q/z.bib")], "root string, path string"))
    assert {(r.path, r.status) for r in bibs.collect()} == {("/p/a.bib", "ok"), ("/p/b.bib", "missing"), ("/q/z.bib", "fallback")}


def test_deep_and_shared_includes(spark):
    chain = [(k, k + 1) for k in range(500)] + [(500, 490)]
    diamonds = [p for k in range(40) for p in ((1000 + 3 * k, 1001 + 3 * k), (1000 + 3 * k, 1002 + 3 * k), (1001 + 3 * k, 1003 + 3 * k), (1002 + 3 * k, 1003 + 3 * k))]
    edges = spark.createDataFrame(chain + diamonds, "src long, dst long")
    got = {(r.root, r.node): r.depth for r in projects.closure(edges, spark.createDataFrame([(0,), (1000,)], "root long")).collect()}
    assert got == {(0, k): k for k in range(501)} | {(1000, 1000 + k): k // 3 * 2 + (k % 3 > 0) for k in range(121)}
    assert projects.closure(edges.limit(0), spark.createDataFrame([(7,)], "root long")).collect() == [(7, 7, 0)]


def test_reading_order_of_shared_files(spark):
    texts = {f"/p/{k}.tex": f"<{k} \\input{{{k}a}} | \\input{{{k}b}} {k}>" for k in range(6)}
    texts |= {f"/p/{k}{s}.tex": f"({k}{s} \\input{{{k + 1}}} {k}{s})" for k in range(6) for s in "ab"} | {"/p/6.tex": "end"}
    files = spark.createDataFrame([("/p", p, t) for p, t in texts.items()], "root string, path string, text string")
    roots = spark.createDataFrame([("/p/0.tex",)], "root string")
    edges = projects.include_edges(files)
    seen = set()

    def read(path):
        if path in seen:
            return ""
        seen.add(path)
        return re.sub(r"\\input\{(\w+)\}", lambda m: read(f"/p/{m[1]}.tex"), texts[path])

    assert "".join(projects.expanded(files, edges, roots).first().text.split()) == "".join(read("/p/0.tex").split())
    order = projects.include_order(edges, roots).collect()
    assert len(order) == 1 + 6 * 4 and sum(not r.repeated for r in order) == 19


def test_files(spark, tmp_path):
    (tmp_path / "a.tex").write_bytes(b"caf\xe9")
    row = projects.read_files(spark, str(tmp_path)).first()
    assert row.path == str(tmp_path / "a.tex") and row.text == "caf�" and row.had_replacement
    (tmp_path / "findings.json").write_text("[]")
    assert projects.read_json(spark, str(tmp_path), ["findings", "claims"]).first()[1:] == ("[]", None)
    out = spark.createDataFrame([("x",)], "v string")
    projects.write_report(out, str(tmp_path / "out"))
    projects.write_report(out, str(tmp_path / "out"), force=True)
    count, source = projects.page_count(("first", F.lit(None).cast("int")), ("second", F.lit(7)))
    assert spark.range(1).select(count, source).first()[:] == (7, "second")


def test_quality_and_extensions(spark):
    rows = spark.createDataFrame([("a", 1, 60.0), ("a", 2, 41.0), ("b", 1, 100.0)], "g string, m int, v double")
    assert [(r.g, float(r.total)) for r in extensions.percent_sums(rows, ["g"], "v").collect()] == [("a", 101.0)]
    assert {(r.g, r.m): r.gain for r in extensions.relative_gains(rows, "g", "m", "v", "1").collect()}[("b", 1)] == 0.0
    assert {r.m: r.wins for r in extensions.win_counts(rows, "g", "m", "v").collect()} == {1: 2}
    found = quality.all_messages(quality.unique_key(rows, F.lit("t"), F.col("g"), F.col("m"), "D1"))
    assert [(r.errors, r.passed) for r in quality.summary(found).collect()] == [(1, False)]


def test_include_closure_of_every_root(spark, tmp_path):
    from folioscan.plans import catalogue

    spark.range(1, 121).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    got = sorted((r.root, r.node, r.depth) for r in catalogue.q36_include_closure(spark, str(tmp_path)).collect())
    assert got == sorted((k, k >> d, d) for k in range(1, 121) for d in range(k.bit_length()))
