"""Audit of review bundles: one row per bundle, its JSON files as text columns, its report's items as a table.

The JSON stays a VARIANT, because some rules tell a missing key from a null. Every rule is one DataFrame of messages
over all bundles at once; cross checks are anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import html_report
from folioscan.operators.html_report import message, message_if, told
from folioscan.operators.quality import all_messages, expected_members, messages, required_fields

# Fixed values of the bundle's contract.
SEVERITIES = ("Blocker", "Major", "Minor", "Polish")
HIGH_RISK = ("Blocker", "Major")
FINDING_FIELDS = ("id", "severity", "location", "reader_friction", "writing_principle", "next_draft_task", "evidence_basis", "verification_method")
HIGH_RISK_FIELDS = ("confidence", "severity_rationale", "downgrade_condition")
NUMERIC_FIELDS = ("reported_value", "visible_computed_value", "delta", "aggregation_caveat")
CLAIM_FIELDS = ("claim_id", "claim_text", "location", "claim_type", "strength", "required_evidence", "visible_evidence", "status", "next_draft_task")
UNIT_FIELDS = ("unit", "total", "reviewed", "with_issues", "clean", "skipped")
PASSES = tuple(f"Pass {k}" for k in range(7))
OBSERVATIONS = (
    "pass_0_engagement_contract", "pass_1_cold_start_skim", "pass_2_linear_deep_read", "pass_3_section_reflections",
    "pass_4_whole_paper_argument", "pass_5_submission_walk", "pass_6_output_calibration",
)
MANIFEST_FIELDS = ("output_files", "sections", "deferred_findings")
SIGNAL_FIELDS = ("table_id", "row_label", "reported_value", "visible_computed_value", "delta", "aggregation_caveat")
VAGUE = ("有偏差", "需复查", "需要核对", "建议复查", "可能有问题", "check", "recheck")
DIRECTIVE = ("wrong", "incorrect", "错误", "算错", "不是")
#: The JSON columns of a bundle.
FILES = ("findings", "claims", "numeric_audit", "coverage", "render_manifest", "pass_observations")


def get(v: str | Column, key: str) -> Column:
    """The key's value as VARIANT: NULL only if the key is missing."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def string(v: str | Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, or the scalar's type."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def empty(value: Column) -> Column:
    """Missing, null, an empty text or an empty list; zero, false and an empty object are not empty."""
    return F.coalesce(F.to_json(value).isin("null", '""', "[]"), F.lit(True))


def array(value: Column) -> Column:
    """The VARIANT's elements; an empty array if it is no list."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def payload(bundles: DataFrame, column: str) -> DataFrame:
    """(bundle_id, v) of the bundles that have the file."""
    return bundles.where(F.col(column).isNotNull()).select("bundle_id", F.try_parse_json(column).alias("v"))


def elements(bundles: DataFrame, column: str, key: str) -> DataFrame:
    """(bundle_id, ord, v): objects of a bare list, or of the list under `key`; ord counts from 1 over all elements."""
    rows = payload(bundles, column)
    items = F.when(kind(F.col("v")) == "ARRAY", array(F.col("v"))).otherwise(array(get("v", key)))
    rows = rows.select("bundle_id", F.posexplode(items).alias("k", "v"))
    return rows.where(kind(F.col("v")) == "OBJECT").select("bundle_id", (F.col("k") + 1).alias("ord"), "v")


def _shape(bundles: DataFrame, column: str, key: str, rule: str) -> DataFrame:
    """A message for a payload that neither is a list nor holds one."""
    rows = payload(bundles, column)
    bad = F.coalesce((kind(F.col("v")) != "ARRAY") & F.coalesce(kind(get("v", key)) != "ARRAY", F.lit(True)), F.lit(True))
    return messages(rows.where(bad), F.col("bundle_id"), rule, F.lit(column), F.lit("no list"))


def _fields(keys, v: str = "v") -> dict[str, Column]:
    return {k: get(v, k) for k in keys}


def _is_object(v: Column) -> Column:
    return F.coalesce(kind(v) == "OBJECT", F.lit(False))


def _finding_id(v: str | Column, place: Column) -> Column:
    return F.coalesce(string(v, "id"), F.concat(F.lit("<missing-"), place.cast("string"), F.lit(">")))


def _required(v: str | Column) -> Column:
    """Whether a signal must be rendered; it must by default."""
    flag = get(v, "render_required")
    return F.when(flag.isNull(), True).otherwise(F.coalesce(F.try_variant_get(flag, "$", "boolean"), ~empty(flag)))


def finding_ids(bundles: DataFrame) -> DataFrame:
    """(bundle_id, id): a finding without an id is named by its place."""
    rows = elements(bundles, "findings", "findings")
    return rows.select("bundle_id", F.coalesce(string("v", "id"), F.concat(F.lit("<missing-"), F.col("ord").cast("string"), F.lit(">"))).alias("id")).distinct()


def missing(fields: dict[str, Column], rule: str, subject: Column, when: Column | None = None, empty=lambda c: c.isNull()) -> Column:
    """An array of one message for each field that is empty, on rows where `when` holds."""
    names = F.filter(F.array(*[F.when(empty(c), F.lit(k)) for k, c in fields.items()]), lambda k: k.isNotNull())
    found = F.transform(names, lambda k: message(rule, subject, k))
    return found if when is None else F.when(F.coalesce(when, F.lit(False)), found).otherwise(F.array().cast(html_report.MESSAGES))


def numbered(rows: DataFrame, subject: Column) -> DataFrame:
    """rows with columns subject and nth, the how manieth of its bundle the subject is."""
    named = rows.withColumn("subject", subject)
    return named.withColumn("nth", F.row_number().over(Window.partitionBy("bundle_id", "subject").orderBy("ord")))


def audit_findings(bundles: DataFrame) -> DataFrame:
    """Findings are exploded once, and every finding makes all of its messages."""
    rows = numbered(elements(bundles, "findings", "findings"), _finding_id("v", F.col("ord")))
    subject, severity = F.col("subject"), string("v", "severity")
    numeric = get("v", "reported_value").isNotNull() | get("v", "visible_computed_value").isNotNull() | get("v", "delta").isNotNull()
    diagnosis, reported, computed = (F.coalesce(string("v", k), F.lit("")) for k in ("diagnosis", "reported_value", "visible_computed_value"))
    lacking = ~F.contains(diagnosis, reported) | ~F.contains(diagnosis, computed)
    both = (reported != "") & (computed != "")
    any_of = lambda text, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    found = F.concat(
        message_if(F.col("nth") > 1, "D1", subject, F.col("nth")),
        missing(_fields(FINDING_FIELDS), "D2", subject, empty=empty),
        message_if(~F.coalesce(severity.isin(*SEVERITIES), F.lit(False)), "D3", subject, severity),
        missing(_fields(HIGH_RISK_FIELDS), "D4", subject, severity.isin(*HIGH_RISK), empty),
        message_if(numeric & ~severity.eqNullSafe(F.lit("Blocker")), "D5", subject, severity),
        missing(_fields(NUMERIC_FIELDS), "D6", subject, numeric, empty),
        message_if(numeric & both & lacking, "D7", subject, F.lit("diagnosis lacks the reported or computed value")),
        message_if(numeric & both & lacking & any_of(F.lower(diagnosis), DIRECTIVE), "D7-directive", subject, F.lit("verdict without both values")),
        message_if(numeric & lacking & any_of(diagnosis, VAGUE), "D7-vague", subject, F.lit("vague without both values")),
    )
    return all_messages(_shape(bundles, "findings", "findings", "D0"), told(rows, found))


def audit_claims(bundles: DataFrame) -> DataFrame:
    """D1, D2 and D8 on claims."""
    rows = elements(bundles, "claims", "claims")
    subject = F.coalesce(string("v", "claim_id"), F.concat(F.lit("<missing-"), F.col("ord").cast("string"), F.lit(">")))
    links = rows.select("bundle_id", subject.alias("claim"), F.explode(array(get("v", "linked_findings")).cast("array<string>")).alias("id"))
    unknown = links.join(finding_ids(bundles), ["bundle_id", "id"], "left_anti")
    found = F.concat(message_if(F.col("nth") > 1, "D1-claim", F.col("subject"), F.col("nth")), missing(_fields(CLAIM_FIELDS), "D2-claim", F.col("subject"), empty=empty))
    return all_messages(_shape(bundles, "claims", "claims", "D0"), told(numbered(rows, subject), found), messages(unknown, F.col("bundle_id"), "D8", F.col("claim"), F.col("id"), "warning"))


def _no_object(bundles: DataFrame, column: str, rule: str) -> DataFrame:
    rows = payload(bundles, column)
    return messages(rows.where(~F.coalesce(kind(F.col("v")) == "OBJECT", F.lit(False))), F.col("bundle_id"), rule, F.lit(column), F.lit("not an object"))


def _objects(bundles: DataFrame, column: str) -> DataFrame:
    return payload(bundles, column).where(kind(F.col("v")) == "OBJECT")


def audit_coverage(bundles: DataFrame) -> DataFrame:
    whole = _objects(bundles, "coverage")
    scope = F.col("bundle_id")
    units = whole.select("bundle_id", F.posexplode(array(get("v", "units"))).alias("k", "u")).withColumn("n", (F.col("k") + 1).cast("string"))
    integer = lambda k: F.when(kind(get("u", k)) == "BIGINT", F.try_variant_get("u", f"$.{k}", "bigint"))
    of_unit = F.concat(
        missing(_fields(UNIT_FIELDS, "u"), "D9-unit", F.col("n")),
        message_if((integer("skipped") > 0) & empty(get("u", "pending_in")), "D10-skipped", F.col("n"), string("u", "unit")),
        message_if(integer("reviewed") > integer("total"), "D10-reviewed", F.col("n"), string("u", "unit")),
    )
    passes = whole.select("bundle_id", array(get("v", "reader_journey_passes")).alias("p"))
    listed = passes.select("bundle_id", F.explode("p").alias("i")).select("bundle_id", string("i", "pass").alias("pass"))
    lacking = expected_members(listed, ["bundle_id"], "pass", list(PASSES))
    return all_messages(
        _no_object(bundles, "coverage", "D9"),
        messages(whole.where(F.size(array(get("v", "units"))) == 0), scope, "D9-units", F.lit("units"), F.lit("empty")),
        told(units, of_unit),
        messages(lacking, scope, "D11", F.col("pass"), F.lit("missing"), "warning"),
        messages(passes.where(F.size("p") == 0), scope, "D11-absent", F.lit("reader_journey_passes"), F.lit("absent"), "warning"),
    )


def observations(bundles: DataFrame) -> DataFrame:
    """(bundle_id, key, is_list, items) for the fixed keys that are present."""
    each = F.array(*[F.struct(F.lit(k).alias("key"), get("v", k).alias("o")) for k in OBSERVATIONS])
    rows = _objects(bundles, "pass_observations").select("bundle_id", F.explode(each).alias("e")).where("e.o IS NOT NULL")
    return rows.select("bundle_id", "e.key", (kind(F.col("e.o")) == "ARRAY").alias("is_list"), array(F.col("e.o")).alias("items"))


def audit_observations(bundles: DataFrame) -> DataFrame:
    scope = F.col("bundle_id")
    whole, rows = _objects(bundles, "pass_observations"), observations(bundles)
    items = rows.select("bundle_id", "key", F.posexplode("items").alias("k", "i")).withColumn("subject", F.concat("key", F.lit(" #"), (F.col("k") + 1).cast("string")))
    is_object = F.coalesce(kind(F.col("i")) == "OBJECT", F.lit(False))
    links = items.where(is_object).select("bundle_id", F.explode(array(get("i", "linked_findings")).cast("array<string>")).alias("id")).distinct()
    counted = whole.select("bundle_id").join(items.groupBy("bundle_id").agg(F.count("*").alias("n")), "bundle_id", "left")
    return all_messages(
        _no_object(bundles, "pass_observations", "D12"),
        messages(expected_members(rows, ["bundle_id"], "key", list(OBSERVATIONS), whole), scope, "D12-key", F.col("key"), F.lit("missing")),
        messages(rows.where(~F.col("is_list")), scope, "D12-list", F.col("key"), F.lit("not a list")),
        told(items, F.concat(message_if(~is_object, "D12-object", F.col("subject"), F.lit("not an object")), message_if(is_object & empty(get("i", "location")), "D12-location", F.col("subject"), F.lit("missing")))),
        messages(counted.where("n IS NULL"), scope, "D12-none", F.lit("pass_observations"), F.lit("no observations"), "warning"),
        messages(links.join(finding_ids(bundles), ["bundle_id", "id"], "left_anti"), scope, "D13", F.col("id"), F.lit("unknown finding"), "warning"),
    )


def deferred(bundles: DataFrame) -> DataFrame:
    """(bundle_id, id) of deferred findings."""
    rows = _objects(bundles, "render_manifest").select("bundle_id", F.explode(array(get("v", "deferred_findings")).cast("array<string>")).alias("id"))
    return rows.where("id <> ''").distinct()


def rendered_sections(bundles: DataFrame) -> DataFrame:
    """(bundle_id, id) of the sections that the manifest calls rendered."""
    rows = _objects(bundles, "render_manifest").select("bundle_id", F.explode(array(get("v", "sections"))).alias("s"))
    return rows.where(string("s", "status") == "rendered").select("bundle_id", string("s", "id").alias("id"))


def audit_manifest(bundles: DataFrame) -> DataFrame:
    scope, whole = F.col("bundle_id"), _objects(bundles, "render_manifest")
    return all_messages(
        _no_object(bundles, "render_manifest", "D14"),
        required_fields(whole, scope, F.lit("render_manifest"), _fields(MANIFEST_FIELDS), "D14-key"),
        messages(deferred(bundles).join(finding_ids(bundles), ["bundle_id", "id"], "left_anti"), scope, "D14-deferred", F.col("id"), F.lit("unknown finding")),
        messages(whole.where(kind(get("v", "sections")) == "ARRAY").join(rendered_sections(bundles), "bundle_id", "left_anti"), scope, "D14-sections", F.lit("sections"), F.lit("none rendered"), "warning"),
    )


def numeric_signals(bundles: DataFrame) -> DataFrame:
    """(bundle_id, ord, v, is_object, required): signals with the default that they must be rendered."""
    rows = _objects(bundles, "numeric_audit").select("bundle_id", F.posexplode(array(get("v", "signals"))).alias("k", "v"))
    return rows.select("bundle_id", (F.col("k") + 1).alias("ord"), "v", _is_object(F.col("v")).alias("is_object"), _required("v").alias("required"))


def audit_signals(bundles: DataFrame) -> DataFrame:
    scope, subject = F.col("bundle_id"), F.col("ord").cast("string")
    whole, rows = payload(bundles, "numeric_audit"), numeric_signals(bundles)
    listed = F.coalesce((kind(F.col("v")) == "OBJECT") & (kind(get("v", "signals")) == "ARRAY"), F.lit(False))
    count = F.when(kind(get("v", "signal_count")) == "BIGINT", F.try_variant_get("v", "$.signal_count", "bigint"))
    flag, is_object = get("v", "render_required"), F.col("is_object")
    of_signal = F.concat(
        message_if(~is_object, "D15-object", subject, F.lit("not an object")),
        missing(_fields(SIGNAL_FIELDS), "D15-field", subject, is_object, empty),
        message_if(is_object & flag.isNotNull() & (kind(flag) != "BOOLEAN"), "D15-flag", subject, F.to_json(flag)),
        message_if(is_object & F.col("required") & ~string("v", "required_severity").eqNullSafe(F.lit("Blocker")), "D15-severity", subject, string("v", "required_severity")),
    )
    return all_messages(
        messages(whole.where(~listed), scope, "D15", F.lit("numeric_audit"), F.lit("no list of signals")),
        messages(whole.where(listed & (count != F.size(array(get("v", "signals"))))), scope, "D15-count", F.lit("signal_count"), count),
        told(rows, of_signal),
    )


def rendering_messages() -> Column:
    """Signals that must be rendered against the row's report: its text has table, values and a token of the row label;
    an issue item about numbers with the values and the place is a Blocker."""
    signals = F.filter(F.transform(array(get(F.try_parse_json("numeric_audit"), "signals")), lambda s, k: F.struct(s.alias("v"), (k + 1).alias("ord"))), lambda x: _is_object(x["v"]) & _required(x["v"]))
    page = T.compact(F.col("html"))
    issues = F.transform(html_report.of_kind("issue", lambda i: (i["issue_type"] == "numeric") & (F.lower(i["severity"]) == "blocker")), lambda i: i["text"])

    def judged(x: Column, page: Column) -> Column:
        said = {k: T.compact(string(x["v"], k)) for k in ("signal_id", "table_id", "row_label", "reported_value", "visible_computed_value", "required_severity")}
        tokens = T.label_tokens(said["row_label"])
        any_in = lambda text: F.exists(tokens, lambda t: F.contains(text, t))
        lacks = [F.when((said[k] != "") & ~F.contains(page, said[k]), F.lit(k)) for k in ("table_id", "reported_value", "visible_computed_value")]
        missing = F.concat_ws(", ", *lacks, F.when((F.size(tokens) > 0) & ~any_in(page), F.lit("row_label")))
        number = F.coalesce(F.nullif(said["signal_id"], F.lit("")), F.concat(F.lit("signal #"), x["ord"].cast("string")))
        key = F.trim(F.concat(number, F.lit(" "), said["table_id"], F.lit(" "), said["row_label"], F.lit(" reported="), said["reported_value"], F.lit(" computed="), said["visible_computed_value"]))
        values = (said["reported_value"] != "") & (said["visible_computed_value"] != "")
        beside = lambda text: F.contains(text, said["reported_value"]) & F.contains(text, said["visible_computed_value"]) & (((said["table_id"] != "") & F.contains(text, said["table_id"])) | any_in(text))
        blocker = values & F.exists(issues, beside)
        lost = html_report.message("D16", key, missing)
        unmarked = html_report.message("D17", key, F.lit("no Blocker beside it"))
        return F.when(missing != "", lost).when((said["required_severity"] == "Blocker") & ~blocker, unmarked)

    found = T.let(page, lambda text: F.transform(signals, lambda x: judged(x, text)))
    return F.filter(found, lambda m: m.isNotNull())


def link_messages(ids: Column) -> Column:
    """Rendered sections and findings against the ids of the row's report."""
    manifest = F.try_parse_json("render_manifest")
    whole = F.when(kind(manifest) == "OBJECT", manifest)
    shown = F.filter(array(get(whole, "sections")), lambda s: F.coalesce(string(s, "status") == "rendered", F.lit(False)))
    sections = F.filter(F.transform(shown, lambda s: string(s, "id")), lambda i: F.coalesce(i != "", F.lit(False)))
    put_off = array(get(whole, "deferred_findings")).cast("array<string>")
    payload_ = F.try_parse_json("findings")
    listed = F.when(kind(payload_) == "ARRAY", array(payload_)).otherwise(array(get(payload_, "findings")))
    placed = F.filter(F.transform(listed, lambda f, k: F.struct(f.alias("v"), k.alias("k"))), lambda x: _is_object(x["v"]))
    findings = F.transform(placed, lambda x: _finding_id(x["v"], x["k"] + 1))
    lost = lambda found, rule, words: F.transform(found, lambda i: html_report.message(rule, i, F.lit(words)))
    return F.concat(
        lost(F.array_except(sections, ids), "D18", "no such id in the report"),
        lost(F.array_except(findings, F.concat(ids, put_off)), "D19", "neither rendered nor deferred"),
    )


def audit_reports(bundles: DataFrame) -> DataFrame:
    """All messages about the bundles' reports, which are parsed once: the page's own rules, the rendering of signals,
    and the links of sections and findings."""
    rows = html_report.with_items(bundles.where("html IS NOT NULL").select("bundle_id", "html", "findings", "numeric_audit", "render_manifest"))
    rows = rows.withColumn("ids", html_report.page_ids())
    return html_report.told(rows, F.concat(html_report.page_messages(F.col("ids")), rendering_messages(), link_messages(F.col("ids"))))


def with_files(bundles: DataFrame) -> DataFrame:
    """bundles with null for the files and the report that the frame has no column for."""
    return bundles.withColumns({k: F.lit(None).cast("string") for k in (*FILES, "html") if k not in bundles.columns})


def audit(bundles: DataFrame) -> DataFrame:
    """All messages of bundles(bundle_id, and a column for each of FILES and html that there is)."""
    rows = with_files(bundles)
    return all_messages(*[f(rows) for f in (audit_findings, audit_claims, audit_signals, audit_coverage, audit_manifest, audit_observations, audit_reports)])
