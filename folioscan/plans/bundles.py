"""Registered queries that audit review bundles and reports made from the tables.

A bundle is a customer with the orders as findings; what is wrong with it hangs on remainders of the keys, so that the SQL
can state every message from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import artifacts, drift, extensions, html_report, signals, tables
from folioscan.plans.catalogue import ORACLE_SQL, QUERIES, _query, _t
from folioscan.sources import projects

__all__ = ["ORACLE_SQL", "QUERIES"]

SEVERITY = {"1-URGENT": "Blocker", "2-HIGH": "Major", "3-MEDIUM": "Minor", "4-NOT SPECIFIED": "Odd", "5-LOW": "Polish"}
_SEVERITY_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITY.items()) + " END"


def _listed(rows: DataFrame, item, name: str, order: str = "o_orderkey") -> DataFrame:
    """(bundle_id, name): the JSON list of every customer's items, in order; null fields are missing keys."""
    grouped = rows.groupBy(F.col("o_custkey").cast("string").alias("bundle_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))).alias("a"))
    return grouped.select("bundle_id", F.to_json(F.col("a.i")).alias(name))


def _orders(spark, sf_dir) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return _t(spark, sf_dir, "orders").withColumn("severity", table[F.col("o_orderpriority")])


def _findings(spark, sf_dir) -> DataFrame:
    rows, key = _orders(spark, sf_dir), F.col("o_orderkey")
    x, gone = F.lit("x"), F.lit(None).cast("string")
    numeric = key % 6 == 0
    diagnosis = F.when(key % 18 == 0, "9.1 is not 8.0").when(key % 18 == 6, "this is wrong").otherwise("please check")
    fields = {
        "id": F.concat(F.lit("F"), (key % 40).cast("string")), "severity": F.col("severity"), "location": F.when(key % 7 == 0, "").otherwise("here"), "reader_friction": x, "writing_principle": x,
        "next_draft_task": F.when(key % 11 != 0, x), "evidence_basis": x, "verification_method": x, "confidence": F.when(key % 5 == 0, gone).otherwise(x), "severity_rationale": x, "downgrade_condition": x,
        "reported_value": F.when(numeric, "9.1"), "visible_computed_value": F.when(numeric, "8.0"), "delta": F.when(numeric, "+1.1"), "aggregation_caveat": F.when(numeric & (key % 12 != 0), x), "diagnosis": F.when(numeric, diagnosis),
    }
    return _listed(rows, F.struct(*[c.alias(k) for k, c in fields.items()]), "findings")


def _shown(found: DataFrame) -> DataFrame:
    return found.select("scope", "level", "rule_id", "subject", "detail")


_FINDINGS_SQL = f"""f AS (SELECT CAST(o_custkey AS VARCHAR) AS scope, o_orderkey AS k, 'F' || o_orderkey % 40 AS id, {_SEVERITY_SQL} AS severity FROM orders)"""


@_query(f"""WITH {_FINDINGS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY scope, id ORDER BY k) AS nth FROM f)
SELECT scope, 'error' AS level, 'D1' AS rule_id, id AS subject, CAST(nth AS VARCHAR) AS detail FROM n WHERE nth > 1
UNION ALL SELECT scope, 'error', 'D2', id, 'location' FROM f WHERE k % 7 = 0 UNION ALL SELECT scope, 'error', 'D2', id, 'next_draft_task' FROM f WHERE k % 11 = 0
UNION ALL SELECT scope, 'error', 'D3', id, severity FROM f WHERE severity = 'Odd' UNION ALL SELECT scope, 'error', 'D4', id, 'confidence' FROM f WHERE severity IN ('Blocker', 'Major') AND k % 5 = 0
UNION ALL SELECT scope, 'error', 'D5', id, severity FROM f WHERE k % 6 = 0 AND severity <> 'Blocker' UNION ALL SELECT scope, 'error', 'D6', id, 'aggregation_caveat' FROM f WHERE k % 12 = 0
UNION ALL SELECT scope, 'error', 'D7', id, 'diagnosis lacks the reported or computed value' FROM f WHERE k % 6 = 0 AND k % 18 <> 0
UNION ALL SELECT scope, 'error', 'D7-directive', id, 'verdict without both values' FROM f WHERE k % 18 = 6 UNION ALL SELECT scope, 'error', 'D7-vague', id, 'vague without both values' FROM f WHERE k % 18 = 12""")
def q66_finding_rules(spark, sf_dir):
    """Every rule of a finding."""
    return _shown(artifacts.audit_findings(artifacts.with_files(_findings(spark, sf_dir))))


@_query(f"""WITH {_FINDINGS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY scope, k % 50 ORDER BY k) AS nth FROM f)
SELECT scope, 'error' AS level, 'D1-claim' AS rule_id, 'C' || k % 50 AS subject, CAST(nth AS VARCHAR) AS detail FROM c WHERE nth > 1
UNION ALL SELECT scope, 'error', 'D2-claim', 'C' || k % 50, 'status' FROM f WHERE k % 9 = 0
UNION ALL SELECT scope, 'warning', 'D8', 'C' || k % 50, 'F' || k % 43 FROM f WHERE (scope, 'F' || k % 43) NOT IN (SELECT (scope, id) FROM f)""")
def q67_claim_rules(spark, sf_dir):
    """D1, D2 and D8 on claims: ids, fields, and links to findings that there are not."""
    key, x = F.col("o_orderkey"), F.lit("x")
    fields = {k: x for k in artifacts.CLAIM_FIELDS} | {"claim_id": F.concat(F.lit("C"), (key % 50).cast("string")), "status": F.when(key % 9 != 0, x)}
    links = F.array(F.concat(F.lit("F"), (key % 43).cast("string")), F.concat(F.lit("F"), (key % 40).cast("string")))
    claims = _listed(_orders(spark, sf_dir), F.struct(*[c.alias(k) for k, c in fields.items()], links.alias("linked_findings")), "claims")
    bundles = _findings(spark, sf_dir).join(claims, "bundle_id")
    return _shown(artifacts.audit_claims(artifacts.with_files(bundles)))


@_query("""WITH u AS (SELECT CAST(o_custkey AS VARCHAR) AS scope, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR) AS n FROM orders),
g AS (SELECT scope, list(DISTINCT k % 8) AS passes FROM u GROUP BY 1)
SELECT scope, 'error' AS level, 'D9-unit' AS rule_id, n AS subject, 'clean' AS detail FROM u WHERE k % 10 = 0
UNION ALL SELECT scope, 'error', 'D10-skipped', n, 'u' || k FROM u WHERE k % 4 = 1 AND k % 3 <> 0 UNION ALL SELECT scope, 'error', 'D10-reviewed', n, 'u' || k FROM u WHERE k % 5 > 3
UNION ALL SELECT scope, 'warning', 'D11', 'Pass ' || p, 'missing' FROM g, (VALUES (0), (1), (2), (3), (4), (5), (6)) v(p) WHERE NOT list_contains(passes, p)""")
def q68_coverage_rules(spark, sf_dir):
    """Units with their numbers, and the passes that a bundle must list."""
    key = F.col("o_orderkey")
    unit = F.struct(F.concat(F.lit("u"), key.cast("string")).alias("unit"), F.lit(3).alias("total"), (key % 5).alias("reviewed"), F.lit(0).alias("with_issues"), F.when(key % 10 != 0, 0).alias("clean"), F.when(key % 4 == 1, 2).otherwise(0).alias("skipped"), F.when(key % 3 == 0, "Pass 2").alias("pending_in"))
    rows = _orders(spark, sf_dir).groupBy(F.col("o_custkey").cast("string").alias("bundle_id")).agg(F.array_sort(F.collect_list(F.struct(key.alias("o"), unit.alias("i")))).alias("a"), F.collect_set(F.struct(F.concat(F.lit("Pass "), (key % 8).cast("string")).alias("pass"))).alias("p"))
    bundles = rows.select("bundle_id", F.to_json(F.struct(F.col("a.i").alias("units"), F.col("p").alias("reader_journey_passes"))).alias("coverage"))
    return _shown(artifacts.audit_coverage(artifacts.with_files(bundles)))


_KEYS_SQL = ", ".join(f"({k}, '{name}')" for k, name in enumerate(artifacts.OBSERVATIONS))


@_query(f"""WITH {_FINDINGS_SQL}, c AS (SELECT DISTINCT scope FROM f), o(n, key) AS (VALUES {_KEYS_SQL}), i AS (SELECT scope, n, key, k, row_number() OVER (PARTITION BY scope, n ORDER BY k) AS nth FROM f JOIN o ON k % 7 = n)
SELECT scope, 'error' AS level, 'D12-key' AS rule_id, key AS subject, 'missing' AS detail FROM c, o WHERE (scope, n) NOT IN (SELECT (scope, n) FROM i)
UNION ALL SELECT scope, 'error', 'D12-location', key || ' #' || nth, 'missing' FROM i WHERE k % 3 = 0
UNION ALL SELECT DISTINCT scope, 'warning', 'D13', 'F' || k % 44, 'unknown finding' FROM f WHERE (scope, 'F' || k % 44) NOT IN (SELECT (scope, id) FROM f)""")
def q69_observation_rules(spark, sf_dir):
    """Observations under their fixed keys, with a location and findings that there are."""
    key = F.col("o_orderkey")
    item = F.struct(F.when(key % 3 == 0, "").otherwise("p. 1").alias("location"), F.array(F.concat(F.lit("F"), (key % 44).cast("string"))).alias("linked_findings"))
    per_key = _orders(spark, sf_dir).groupBy(F.col("o_custkey").cast("string").alias("bundle_id")).agg(F.array_sort(F.collect_list(F.struct(key.alias("o"), (key % 7).alias("n"), item.alias("i")))).alias("a"))
    own = lambda n: F.transform(F.filter("a", lambda x: x["n"] == n), lambda x: x["i"])
    members = [F.when(F.size(own(n)) > 0, own(n)).alias(name) for n, name in enumerate(artifacts.OBSERVATIONS)]
    bundles = _findings(spark, sf_dir).join(per_key.select("bundle_id", F.to_json(F.struct(*members)).alias("pass_observations")), "bundle_id")
    return _shown(artifacts.audit_observations(artifacts.with_files(bundles)))


def _manifest() -> F.Column:
    """A manifest by customer: one key of three missing, deferred findings that may not exist, sections rendered or not."""
    key = F.col("bundle_id").cast("bigint")
    shown = F.when(key % 5 == 0, "skipped").otherwise("rendered")
    return F.to_json(F.struct(F.when(key % 3 != 0, F.array(F.lit("a"))).alias("output_files"), F.array(F.struct(F.lit("issue-index").alias("id"), shown.alias("status")), F.struct(F.lit("gone").alias("id"), F.when(key % 7 == 0, "rendered").otherwise("skipped").alias("status"))).alias("sections"), F.array(F.lit("F1"), F.concat(F.lit("F"), (key % 60).cast("string"))).alias("deferred_findings")))


@_query(f"""WITH {_FINDINGS_SQL}, c AS (SELECT DISTINCT scope, CAST(scope AS BIGINT) AS key FROM f), d AS (SELECT DISTINCT scope, id FROM (SELECT scope, 'F1' AS id FROM c UNION ALL SELECT scope, 'F' || key % 60 FROM c))
SELECT scope, 'error' AS level, 'D14-key' AS rule_id, 'render_manifest' AS subject, 'output_files' AS detail FROM c WHERE key % 3 = 0
UNION ALL SELECT scope, 'error', 'D14-deferred', id, 'unknown finding' FROM d WHERE (scope, id) NOT IN (SELECT (scope, id) FROM f)
UNION ALL SELECT scope, 'warning', 'D14-sections', 'sections', 'none rendered' FROM c WHERE key % 5 = 0 AND key % 7 <> 0""")
def q70_manifest_rules(spark, sf_dir):
    """Keys, deferred findings and rendered sections of a manifest."""
    return _shown(artifacts.audit_manifest(artifacts.with_files(_findings(spark, sf_dir).withColumn("render_manifest", _manifest()))))


@_query("""WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS scope, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT DISTINCT scope, 'error' AS level, 'D15-count' AS rule_id, 'signal_count' AS subject, '4' AS detail FROM s WHERE c <> 4
UNION ALL SELECT scope, 'error', 'D15-field', n, 'delta' FROM s WHERE k % 3 = 0 UNION ALL SELECT scope, 'error', 'D15-flag', n, '"yes"' FROM s WHERE k % 4 = 0
UNION ALL SELECT scope, 'error', 'D15-severity', n, CASE WHEN k % 5 = 0 THEN 'Major' END FROM s WHERE k % 5 < 2""")
def q71_signal_rules(spark, sf_dir):
    """The numeric payload's count, fields, flags and severities."""
    key, x = F.col("o_orderkey"), F.lit("x")
    fields = {k: x for k in artifacts.SIGNAL_FIELDS} | {"delta": F.when(key % 3 == 0, "").otherwise("+1"), "render_required": F.when(key % 4 == 0, "yes"), "required_severity": F.when(key % 5 == 0, "Major").when(key % 5 > 1, "Blocker")}
    signals = _orders(spark, sf_dir).groupBy(F.col("o_custkey").cast("string").alias("bundle_id")).agg(F.array_sort(F.collect_list(F.struct(key.alias("o"), F.struct(*[c.alias(k) for k, c in fields.items()]).alias("i")))).alias("a"))
    bundles = signals.select("bundle_id", F.to_json(F.struct(F.lit(4).alias("signal_count"), F.col("a.i").alias("signals"))).alias("numeric_audit"))
    return _shown(artifacts.audit_signals(artifacts.with_files(bundles)))


NOTE_ROWS = '<table><caption>c</caption><tr data-note-kind="sentence" data-severity="minor"><td>s</td></tr><tr data-note-kind="paragraph" data-decision="keep"><td>p</td></tr><tr data-note-kind="section" data-severity="minor"><td>t</td></tr></table>'
#: What a page lacks or has too much by remainders of the customer's key: where, modulus, text, SQL of the message.
DEFECTS = (
    ("issue-index", 4, '<a href="#nowhere">x</a>', "H4', 'nowhere', 'error"),
    ("issue-index", 5, "<p>降级条件</p>", "H9', 'issue-index', 'error"),
    ("revision-plan", 6, "<table><tr><td>a</td></tr></table>", "H13-caption', '', 'error"),
    ("revision-plan", 7, "<table id='t'><caption>c</caption><tr><th>x</th></tr></table>", "H13-scope', 't', 'error"),
    ("local-comments", 9, '<div id="margin-notes"></div>', "H6', 'margin-notes', 'error"),
    ("local-comments", 11, "<p>Avg may differ by hidden decimals</p>", "H10', 'text', 'error"),
    ("executive-diagnosis", 13, "<p>the reported_value is</p>", "H11', 'text', 'error"),
    ("executive-diagnosis", 15, "<table><caption>c</caption><tr><td>Sentence notes</td><td>4</td></tr></table>", "H7', 'sentence', 'error"),
    ("coverage-receipt", 17, "<i>pending in x</i>", "H8-pending', 'coverage', 'warning"),
)


def _pages(spark, sf_dir) -> DataFrame:
    """(bundle_id, html): a report for every customer, with the defects that its key picks."""
    key = F.col("c_custkey")
    parts = []
    for name in html_report.REQUIRED:
        inner = [F.when(key % modulus == 0, F.lit(text)).otherwise(F.lit("")) for where, modulus, text, _ in DEFECTS if where == name]
        if name == html_report.NOTES:
            inner.append(F.when(key % 10 != 3, F.lit(NOTE_ROWS)).otherwise(F.lit("")))
        whole = F.concat(F.lit(f'<section id="{name}">'), *inner, F.lit("</section>"))
        parts.append(F.when(key % 8 == 7, F.lit("")).otherwise(whole) if name == "claim-evidence-audit" else whole)
    last = F.concat(F.when(key % 12 != 5, F.lit("<div>Coverage consistency</div>")).otherwise(F.lit("")), F.when(key % 14 == 3, F.lit('<a href="#F12">x</a>')).otherwise(F.lit("")), F.when(key % 16 == 9, F.lit("<p>open")).otherwise(F.lit("")))
    return _t(spark, sf_dir, "customer").select(key.cast("string").alias("bundle_id"), F.concat(F.lit("<html><body>"), *parts, last, F.lit("</body></html>")).alias("html"))


_PAGE_SQL = " UNION ALL ".join(f"SELECT k, '{told}' FROM c WHERE k % {modulus} = 0" for _, modulus, _, told in DEFECTS)


@_query(f"""WITH c AS (SELECT c_custkey AS k FROM customer), m(k, rule_id, subject, level) AS ({_PAGE_SQL}
UNION ALL SELECT k, 'H2', 'claim-evidence-audit', 'error' FROM c WHERE k % 8 = 7 UNION ALL SELECT k, 'H5', n, 'error' FROM c, (VALUES ('sentence'), ('paragraph'), ('section')) v(n) WHERE k % 10 = 3
-- the text of a paragraph is its section's too, so it is told of both
UNION ALL SELECT k, 'H10', 'text', 'error' FROM c WHERE k % 11 = 0 UNION ALL SELECT k, 'H11', 'text', 'error' FROM c WHERE k % 13 = 0
UNION ALL SELECT k, 'H8', 'coverage', 'warning' FROM c WHERE k % 12 = 5 UNION ALL SELECT k, r, 'F12', 'error' FROM c, (VALUES ('H4'), ('H12')) v(r) WHERE k % 14 = 3 UNION ALL SELECT k, 'H3', 'page', 'error' FROM c WHERE k % 16 = 9)
SELECT CAST(k AS VARCHAR) AS scope, level, rule_id, subject FROM m""")
def q72_report_rules(spark, sf_dir):
    """Every rule of a rendered report, from one parse of each page."""
    return html_report.audit(_pages(spark, sf_dir)).select("scope", "level", "rule_id", "subject")


def _reports(spark, sf_dir) -> DataFrame:
    """Bundles with two findings, one numeric signal, a manifest and a report that renders some of it."""
    key = F.col("c_custkey")
    findings = F.lit('[{"id": "F1"}, {"id": "F2"}]')
    signal = F.lit('{"signals": [{"signal_id": "N1", "table_id": "Table 2", "row_label": "Base model", "reported_value": "9.1", "visible_computed_value": "8.0", "required_severity": "Blocker"}]}')
    manifest = F.concat(F.lit('{"sections": [{"id": "issue-index", "status": "rendered"}, {"id": "'), F.when(key % 5 == 0, "gone").otherwise("issue-index"), F.lit('", "status": "rendered"}], "deferred_findings": ['), F.when(key % 4 == 0, '"F2"').otherwise(""), F.lit("]}"))
    item = F.concat(F.lit('<section id="issue-index"><article id="F1" data-severity="'), F.when(key % 2 == 0, "blocker").otherwise("minor"), F.lit('" data-issue-type="'), F.when(key % 9 == 0, "layout").otherwise("numeric"), F.lit('"><p>'), F.when(key % 7 == 0, "Base: reported 9.1").otherwise("Table 2, Base: reported 9.1, computed 8.0"), F.lit("</p></article></section>"))
    page = F.concat(F.lit("<html>"), item, F.when(key % 3 == 0, F.lit('<p id="F2">second</p>')).otherwise(F.lit("")), F.lit("</html>"))
    return _t(spark, sf_dir, "customer").select(key.cast("string").alias("bundle_id"), findings.alias("findings"), signal.alias("numeric_audit"), manifest.alias("render_manifest"), page.alias("html"))


@_query("""WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS scope FROM customer), w AS (SELECT 'N1 Table 2 Base model reported=9.1 computed=8.0' AS s)
SELECT scope, 'D16' AS rule_id, s AS subject, 'table_id, visible_computed_value' AS detail FROM c, w WHERE k % 7 = 0
UNION ALL SELECT scope, 'D17', s, 'no Blocker beside it' FROM c, w WHERE k % 7 <> 0 AND (k % 2 <> 0 OR k % 9 = 0)
UNION ALL SELECT scope, 'D18', 'gone', 'no such id in the report' FROM c WHERE k % 5 = 0 UNION ALL SELECT scope, 'D19', 'F2', 'neither rendered nor deferred' FROM c WHERE k % 3 <> 0 AND k % 4 <> 0""")
def q73_report_links(spark, sf_dir):
    """Signals, sections and findings against the report."""
    found = artifacts.audit_reports(artifacts.with_files(_reports(spark, sf_dir)))
    return found.where(F.startswith("rule_id", F.lit("D"))).select("scope", "rule_id", "subject", "detail")


@_query("""WITH m AS (SELECT CAST(c_custkey AS VARCHAR) AS scope, (c_custkey % 7 = 0)::INT + (c_custkey % 7 <> 0 AND (c_custkey % 2 <> 0 OR c_custkey % 9 = 0))::INT + (c_custkey % 5 = 0)::INT + (c_custkey % 3 <> 0 AND c_custkey % 4 <> 0)::INT AS d FROM customer)
SELECT scope, CAST(d + 31 AS BIGINT) AS errors, false AS passed FROM m""")
def q74_bundle_audit(spark, sf_dir):
    """The whole audit of a bundle, counted; its findings have an id alone and its report one section."""
    from folioscan.operators import quality

    return quality.summary(artifacts.audit(_reports(spark, sf_dir))).select("scope", "errors", "passed")


@_query("""WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS scope FROM customer) SELECT scope AS bundle_id, 'F1' AS element_id FROM c WHERE k % 2 <> 0""")
def x07_badges(spark, sf_dir):
    """Badges of a report whose finding is not in the bundle."""
    rows = _reports(spark, sf_dir)
    items = html_report.html_items(rows)
    findings = rows.where(F.col("bundle_id").cast("bigint") % 2 == 0).select("bundle_id", F.lit("F1").alias("id"))
    return extensions.badges_without_finding(items, findings)


@_query("""SELECT CAST(c_custkey AS VARCHAR) AS bundle_id, CASE c_custkey % 4 WHEN 0 THEN 'method' ELSE 'writing' END AS issue_type FROM customer WHERE c_custkey % 4 < 2""")
def x12_issue_types(spark, sf_dir):
    """Issue types outside the report's ten."""
    key = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("method", "writing", "math", "prose")]), (key % 4 + 1).cast("int"))
    pages = _t(spark, sf_dir, "customer").select(key.cast("string").alias("bundle_id"), F.concat(F.lit('<div data-severity="minor" data-issue-type="'), kind, F.lit('">x</div>')).alias("html"))
    return extensions.unknown_issue_types(html_report.html_items(pages)).select("bundle_id", "issue_type")


# --- runs and small functions -----------------------------------------------------------------------------------------


def _run(spark, sf_dir, second: bool) -> DataFrame:
    """Every customer's findings in one of two runs; a third of them have no id and are named by place and claim type."""
    rows, key = _orders(spark, sf_dir), F.col("o_orderkey")
    severity = F.when(F.lit(second) & (key % 7 == 0), "Blocker").otherwise(F.col("severity"))
    reason = F.when((key % 5 == 0) & F.lit(second), "").otherwise("why")
    item = F.struct(F.when(key % 3 != 0, F.concat(F.lit("F"), key.cast("string"))).alias("id"), F.concat(F.lit(" L"), key.cast("string")).alias("location"), F.lit("Type").alias("claim_type"), severity.alias("severity"), reason.alias("severity_rationale"))
    return _listed(rows.where(key % 11 != 0) if second else rows, item, "findings")


_RANK = "CASE {} WHEN 'Polish' THEN 0 WHEN 'Minor' THEN 1 WHEN 'Major' THEN 2 WHEN 'Blocker' THEN 3 END"


@_query(f"""WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS scope, o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN 'F' || o_orderkey ELSE 'l' || o_orderkey || '::type' END AS key, {_SEVERITY_SQL} AS a FROM orders),
b AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'Blocker' ELSE a END AS s FROM f)
SELECT scope, key, 'only_in_first' AS kind, CAST(NULL AS VARCHAR) AS detail FROM b WHERE k % 11 = 0
UNION ALL SELECT scope, key, 'severity', a || ' -> ' || s || ' (distance ' || coalesce(CAST(abs({_RANK.format('a')} - {_RANK.format('s')}) AS VARCHAR), 'unknown') || ')' FROM b WHERE k % 11 <> 0 AND a <> s
UNION ALL SELECT scope, key, 'rationale', 'true -> false' FROM b WHERE k % 11 <> 0 AND k % 5 = 0""")
def q78_finding_drift(spark, sf_dir):
    """Two runs of findings as JSON, with and without ids."""
    first, second = (drift.findings(_run(spark, sf_dir, later)) for later in (False, True))
    return drift.compare(first, second).where("scope IS NOT NULL").select("scope", "key", "kind", "detail")


@_query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS pages, CASE WHEN p_size % 2 = 0 THEN 'tool' WHEN p_size % 3 = 0 THEN 'library' END AS source, CASE WHEN p_size % 4 = 0 THEN 99 ELSE 2 END AS depth, 'abc,d_e,fgh-1,ijk' AS tokens,
  CASE p_size % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.05 ELSE 0.005 END AS tolerance, CASE WHEN p_size >= 20 THEN 'deterministic' WHEN p_size >= 5 THEN 'likely_error' ELSE 'ambiguous' END AS tier FROM part""".replace("CASE WHEN p_size % 2 = 0 THEN p_size END AS pages", "CASE WHEN p_size % 2 = 0 THEN p_size WHEN p_size % 3 = 0 THEN 7 END AS pages"))
def q79_small_functions(spark, sf_dir):
    """Page counts with their source, depths, tokens, tolerances and tiers."""
    size = F.col("p_size").cast("int")
    pages, source = projects.page_count(("tool", F.when(size % 2 == 0, size)), ("library", F.when(size % 3 == 0, 7)))
    depth = T.path_depth(F.concat(F.when(size % 4 == 0, "/other").otherwise("/root"), F.lit("/a/b.tex")), F.lit("/root"))
    tokens = T.label_tokens(F.lit("ab abc d_e (fgh-1) ijk lmn"))
    gap = T.gap(F.lit(1000.0) + size / 10, F.lit(1000.0))["tier"]
    return _t(spark, sf_dir, "part").select("p_partkey", pages.alias("pages"), source.alias("source"), depth.alias("depth"), F.array_join(tokens, ",").alias("tokens"), T.tolerance(size % 3).alias("tolerance"), gap.alias("tier"))


@_query("""SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS n_signals FROM part""")
def q80_year_like(spark, sf_dir):
    """A summary that reads like a year or a page is skipped, as is a numbered line of prose."""
    last = F.when(F.col("p_size") % 2 == 0, "2020.5").otherwise("2020")
    text = F.concat(F.lit("Table 1 x\nModel Part Part Part Avg.\nAlpha 1.5 2.5 3.5 "), last, F.lit("\n7 items 1.5 2.5 9.5\nline 1.5 2.5 3.5 9.5"))
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    found = tables.line_signals(docs).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_signals"))


@_query("""WITH l AS (SELECT p_partkey AS doc_id, p_name, p_type FROM part)
SELECT doc_id, '00 headings' AS section, 1 AS ord, 'Abstract' AS item FROM l UNION ALL SELECT doc_id, '01 captions', 1, 'Figure 4: shows ' || p_type || ' parts' FROM l
UNION ALL SELECT doc_id, '02 numbers', 1, 'mean of 3 cells = 2.50; delta +7.00' FROM l UNION ALL SELECT doc_id, '04 placeholders', 1, 'line 2: ??' FROM l
UNION ALL SELECT doc_id, '05 todos', 1, 'line 2: TODO' FROM l UNION ALL SELECT doc_id, '06 identity', 1, 'email: u' || doc_id || '@example.com' FROM l""")
def q81_text_summary(spark, sf_dir):
    """The summary of extracted text, its numbers by their last part."""
    text = F.concat_ws("\n", F.lit("Abstract"), F.lit("we say TODO ??"), F.concat(F.lit("Figure 4: shows "), F.col("p_type"), F.lit(" parts")), F.lit("Table 3 x"), F.lit("Model Part Part Part Avg."), F.lit("Alpha 1.50 2.50 3.50 9.50"), F.concat(F.lit("mail u"), F.col("p_partkey").cast("string"), F.lit("@example.com")))
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    found = signals.summary(docs, "pdf").where("section <> '03 words'")
    return found.select("doc_id", "section", "ord", F.coalesce(F.nullif(F.regexp_extract("item", r"(mean of 3 cells.*)$", 1), F.lit("")), "item").alias("item"))
