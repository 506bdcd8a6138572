"""Bibliography entries and the drift of their style."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import patterns as P
from folioscan.functions import text as T
from folioscan.operators.quality import all_messages


def entries(docs: DataFrame) -> DataFrame:
    """(doc_id, entry_no, type, key, fields): entries of bibliography text. Of a repeated field the last value counts;
    only braced and quoted values are read."""
    # the text is cut in front of every line that starts an entry; a piece without a head is something else
    pieces = F.filter(F.split("text", P.ENTRY_START), lambda p: T.has(p, P.ENTRY_HEAD))
    rows = docs.select("doc_id", F.posexplode(pieces).alias("entry_no", "piece"))
    head = lambda group: F.regexp_extract("piece", P.ENTRY_HEAD, group)
    start = F.regexp_instr("piece", F.lit(P.ENTRY_HEAD)) + F.length(head(0))
    rows = rows.select("doc_id", "entry_no", F.lower(head(1)).alias("type"), F.trim(head(2)).alias("key"), F.substr("piece", start).alias("body"))
    names, values = (T.find_all(F.col("body"), P.ASSIGNMENT, group) for group in (1, 2))
    unwrapped = lambda v: T.one_line(F.substr(v, F.lit(2), F.length(v) - 2))
    rows = rows.withColumn("p", F.zip_with(names, values, lambda k, v: F.struct(F.lower(k).alias("k"), unwrapped(v).alias("v"))))
    last = F.filter("p", lambda x, i: ~F.exists(F.slice("p", i + 2, F.size("p")), lambda y: y["k"] == x["k"]))
    return rows.select("doc_id", "entry_no", "type", "key", F.map_from_entries(last).alias("fields"))


def publications(docs: DataFrame) -> DataFrame:
    """(doc_id, n_publications): entry starts, strings, comments and preambles not counted."""
    return docs.select("doc_id", F.regexp_count("text", F.lit(P.BIB_PUBLICATION)).cast("bigint").alias("n_publications"))


def _field(name: str):
    return F.nullif(F.try_element_at("fields", F.lit(name)), F.lit(""))


def coverage(rows: DataFrame) -> DataFrame:
    """(doc_id, entry_no, type, key, venue, has_url, has_doi, has_eprint, pages) of entries."""
    flag = lambda k: F.when(_field(k).isNotNull(), "yes").otherwise("no").alias(f"has_{k}")
    venue = F.coalesce(_field("booktitle"), _field("journal"), _field("publisher"), F.lit(""))
    return rows.select("doc_id", "entry_no", "type", "key", venue.alias("venue"), flag("url"), flag("doi"), flag("eprint"), F.coalesce(_field("pages"), F.lit("")).alias("pages"))


def presence_drift(rows: DataFrame, scope: str, fields: list[str]) -> DataFrame:
    """(scope, field, n_with, n_total): fields that some rows of a scope have (not null) and others lack."""
    counted = rows.groupBy(scope).agg(F.count("*").alias("n_total"), *[F.count(k).alias(k) for k in fields])
    listed = counted.select(scope, "n_total", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("n_with")) for k in fields])).alias("f"))
    return listed.select(scope, "f.field", "f.n_with", "n_total").where("n_with > 0 AND n_with < n_total")


def type_mix(rows: DataFrame, scope: str, kind: str) -> DataFrame:
    """(scope, kind, n): counts by kind in the scopes that have more than one."""
    counts = rows.where(F.col(kind).isNotNull()).groupBy(scope, kind).agg(F.count("*").alias("n"))
    mixed = counts.groupBy(scope).agg(F.count("*").alias("kinds")).where("kinds > 1")
    return counts.join(mixed.select(scope), scope, "left_semi")


def length_mix(rows: DataFrame, scope: str, value: str, order: str, short: int = 14, long: int = 35) -> DataFrame:
    """(scope, n_short, n_long, first_short, first_long): scopes with both short and long values."""
    brief, wide = F.length(value).between(1, short), F.length(value) >= long
    out = rows.groupBy(scope).agg(F.count_if(brief).alias("n_short"), F.count_if(wide).alias("n_long"), F.min_by(value, F.when(brief, F.col(order))).alias("first_short"), F.min_by(value, F.when(wide, F.col(order))).alias("first_long"))
    return out.where("n_short > 0 AND n_long > 0")


def style_drift(rows: DataFrame, scope: str = "doc_id") -> DataFrame:
    """(scope, kind, detail): field presence, entry types, title forms and page separators that are mixed in a scope,
    or one row "none" where nothing is."""
    named = rows.withColumns({k: F.try_element_at("fields", F.lit(k)) for k in ("url", "doi", "eprint")}).withColumn("pages", _field("pages"))
    presence = presence_drift(named, scope, ["url", "doi", "eprint"]).select(scope, F.lit("field_presence").alias("kind"), F.concat(F.col("field"), F.lit(" "), F.col("n_with").cast("string"), F.lit("/"), F.col("n_total").cast("string")).alias("detail"))
    joined = lambda mix, kind, name: mix.groupBy(scope).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(kind), F.lit("="), F.col("n").cast("string")))), ", ").alias("detail")).select(scope, F.lit(name).alias("kind"), "detail")
    types = joined(type_mix(rows, scope, "type"), "type", "entry_types")
    titles = length_mix(rows.where("type = 'inproceedings'").withColumn("t", _field("booktitle")), scope, "t", "entry_no")
    titles = titles.select(scope, F.lit("booktitles").alias("kind"), F.concat_ws(" | ", F.col("n_short").cast("string"), "first_short", F.col("n_long").cast("string"), "first_long").alias("detail"))
    dash = F.when(F.contains("pages", F.lit("--")), "double-dash").when(F.contains("pages", F.lit("-")), "single-dash")
    pages = joined(type_mix(named.withColumn("dash", dash), scope, "dash"), "dash", "page_separators")
    found = all_messages(presence, types, titles, pages)
    clean = rows.select(scope).distinct().join(found.select(scope), scope, "left_anti").select(scope, F.lit("none").alias("kind"), F.lit(None).cast("string").alias("detail"))
    return found.unionByName(clean)
