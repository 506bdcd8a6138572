"""Equations, macros and the consistency of notation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import patterns as P
from folioscan.functions import text as T
from folioscan.operators import quality, signals


def equations(docs: DataFrame) -> DataFrame:
    """(doc_id, eq_no, label, body): named environments first, then display math that is not blank."""
    text = F.col("text")
    named = F.zip_with(T.find_all(text, P.EQUATION, 1), T.find_all(text, P.EQUATION, 2), lambda e, b: F.struct(e.alias("e"), b.alias("b")))
    named = F.transform(named, lambda x, i: F.struct(F.concat(x["e"], F.lit(" "), (i + 1).cast("string")).alias("label"), x["b"].alias("body")))
    shown = F.zip_with(T.find_all(text, P.DISPLAY_MATH, 1), T.find_all(text, P.DISPLAY_MATH, 2), lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b, F.lit("")))
    shown = F.transform(shown, lambda b, i: F.struct(F.concat(F.lit("display math "), (i + 1).cast("string")).alias("label"), b.alias("body")))
    every = F.concat(named, F.filter(shown, lambda x: T.compact(x["body"]) != ""))
    return docs.select("doc_id", F.posexplode(every).alias("eq_no", "q")).select("doc_id", "eq_no", "q.label", "q.body")


def macros(docs: DataFrame) -> DataFrame:
    """(doc_id, name, ord, expansion): definitions in the three syntaxes, read one syntax after the other."""
    text = F.col("text")
    pairs = lambda p: F.zip_with(T.find_all(text, p, 1), T.find_all(text, p, 2), lambda n, e: F.struct(n.alias("name"), T.snippet(e).alias("expansion")))
    every = F.concat(pairs(P.NEW_COMMAND), pairs(P.DEF), pairs(P.MATH_OPERATOR))
    return docs.select("doc_id", F.posexplode(every).alias("ord", "m")).select("doc_id", "m.name", "ord", "m.expansion")


def used_commands(docs: DataFrame) -> DataFrame:
    """(doc_id, command, eq_no, label): commands in equations, with every place."""
    eqs = equations(docs)
    return eqs.select("doc_id", F.explode(T.find_all(T.strip_comments(F.col("body")), P.MATH_COMMAND, 1)).alias("command"), "eq_no", "label")


def unknown_commands(docs: DataFrame) -> DataFrame:
    """(doc_id, command, locations): commands that are neither known, Greek, nor defined in the document."""
    used = used_commands(docs).where(~F.col("command").isin([*P.KNOWN_COMMANDS, *P.GREEK]))
    unknown = used.join(macros(docs).select("doc_id", F.col("name").alias("command")).distinct(), ["doc_id", "command"], "left_anti")
    firsts = unknown.groupBy("doc_id", "command", "label").agg(F.min("eq_no").alias("eq_no"))
    return firsts.groupBy("doc_id", "command").agg(F.slice(F.array_sort(F.collect_list(F.struct("eq_no", "label"))), 1, 5)["label"].alias("locations"))


def variant_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, first, second): listed glyph pairs of which a document's equations use both."""
    used = used_commands(docs).groupBy("doc_id").agg(F.collect_set("command").alias("tokens"))
    return signals.pairs_present(used, "tokens", P.VARIANT_PAIRS).select("doc_id", "first", "second")


def symbol_signals(docs: DataFrame, limit: int = 100) -> DataFrame:
    """(doc_id, ord, kind, subject, detail, total, incomplete): redefined macros, unknown commands and glyph pairs,
    in that order, capped per document with a flag where the cap cuts."""
    parts = [
        signals.redefinitions(macros(docs)).select("doc_id", F.lit("1 redefined").alias("kind"), F.col("name").alias("subject"), F.array_join("preview", "; ").alias("detail")),
        unknown_commands(docs).select("doc_id", F.lit("2 unknown").alias("kind"), F.col("command").alias("subject"), F.array_join("locations", ", ").alias("detail")),
        variant_pairs(docs).select("doc_id", F.lit("3 variants").alias("kind"), F.col("first").alias("subject"), F.col("second").alias("detail")),
    ]
    window = Window.partitionBy("doc_id")
    rows = quality.all_messages(*parts).withColumn("ord", F.row_number().over(window.orderBy("kind", "subject"))).withColumn("total", F.count("*").over(window))
    return rows.where(F.col("ord") <= T.positive(limit)).withColumn("incomplete", F.col("total") > limit)
