"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that participant as the assistant and all
others as named users; the mask lists the character spans that a loss may count, which are that participant's own
words and their end marks. A rendering is whole. Only if it has more than MAX_TURNS turns it is handed out in several
rows, whose texts put together in order are the rendering and whose spans are places in it, so that a conversation of
any length is spread. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns in one row of a rendering.
MAX_TURNS = 256
#: Tasks over which the rows of one conversation are spread.
SALTS = 16
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
#: Its turns are context in every rendering; it is nobody's perspective.
SYSTEM = "system"
#: The name of a turn without a role.
NOBODY = "unknown"


def _safe(text: Column) -> Column:
    """An opening mark in a text gets one more backslash inside, so that no text can forge a turn; taking one away
    again gives the text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _name(role: Column) -> Column:
    """The role with backslashes, quotes and line ends escaped, so that different roles stay different names."""
    plain = F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.coalesce(_safe(plain), F.lit(NOBODY))


def _header(name: Column, perspective: Column) -> Column:
    user = F.concat(F.lit(OPEN + 'user name="'), name, F.lit('"' + CLOSE + "\n"))
    return F.when(name.eqNullSafe(perspective), F.lit(f"{OPEN}assistant{CLOSE}\n")).when(name == SYSTEM, F.lit(f"{OPEN}system{CLOSE}\n")).otherwise(user)


def rotate_perspectives(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_turns: int = MAX_TURNS) -> DataFrame:
    """One row per conversation, participant and max_turns turns: (id, part, perspective, n_turns, n_own, n_chars, start,
    rendered, mask).

    part counts the rows of one rendering from 0, start is where rendered begins in it. mask is an array of structs
    (start, stop) in characters of the whole rendering, stop exclusive, in order; a participant who is silent in a part
    has none there. Null text is an empty turn, a null role the participant "unknown", a null id a conversation of its
    own. Turns are ordered by number (null in front), name and text, and rows that repeat all of these are rendered as
    often as they occur. A conversation of system turns alone gives no row, an empty table none at all. Backslashes,
    quotes and line ends in names are escaped. Extra columns are ignored. Rows of one conversation and block of
    max_turns turn numbers are counted in one task.
    """
    key = F.coalesce(F.concat(F.lit("c"), F.col(id_col).cast("string")), F.lit("n"))
    block = F.floor(F.coalesce(F.col(turn_col), F.lit(-(2**62))) / F.lit(max_turns)).cast("bigint")
    turns = df.select(key.alias("k"), F.col(id_col).alias("cid"), block.alias("block"), F.col(turn_col).alias("turn"), _name(F.col(role_col)).alias("name"), _safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    counts = turns.groupBy("k", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("k", "block").orderBy("turn", "name", "text"))
    placed = turns.withColumn("nth", nth).join(counts.select("k", "block", before.alias("before")), ["k", "block"])
    place = F.col("before") + F.col("nth") - 1
    placed = placed.select("k", "cid", F.floor(place / max_turns).cast("bigint").alias("part"), place.alias("place"), "name", "text")
    parts = placed.groupBy("k", "cid", "part").agg(F.array_sort(F.collect_list(F.struct("place", "name", "text"))).alias("turns"))
    # what a part is long if nobody in it is the assistant, and how many turns each participant has in it
    said = placed.groupBy("k", "part", "name").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    user = F.length(_header(F.col("name"), F.lit(None).cast("string"))).cast("bigint")
    lengths = said.groupBy("k", "part").agg(F.sum(F.col("chars") + F.col("n") * (user + len(END) + 1)).alias("length"))
    ahead = F.coalesce(F.sum("length").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = lengths.select("k", "part", ahead.alias("ahead"), F.least(F.max("part").over(Window.partitionBy("k")) + 1, F.lit(SALTS)).alias("salts"))
    people = said.where(F.col("name") != SYSTEM).groupBy("k", F.col("name").alias("perspective")).agg(F.collect_list(F.struct("part", "n")).alias("own"))
    people = people.join(lengths.groupBy("k").agg(F.first("salts").alias("salts")), "k").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts")
    views = parts.join(lengths.select("k", "part", "ahead"), ["k", "part"]).withColumn("salt", F.pmod("part", F.lit(SALTS).cast("bigint"))).join(people, ["k", "salt"])
    who = F.col("perspective")
    earlier = F.aggregate(F.filter("own", lambda o: o["part"] < F.col("part")), F.lit(0).cast("bigint"), lambda n, o: n + o["n"])
    shorter = F.length(_header(who, F.lit(None).cast("string"))) - F.length(_header(who, who))
    views = views.withColumn("start", F.col("ahead") - earlier * shorter)
    piece = lambda t: F.concat(_header(t["name"], who), t["text"], F.lit(END + "\n"))
    spans = "array<struct<start:bigint,stop:bigint>>"

    def step(acc: Column, t: Column) -> Column:
        start = acc["pos"] + F.length(_header(t["name"], who))
        stop = start + F.length(t["text"]) + F.lit(len(END))
        own = F.when(t["name"] == who, F.array(F.struct(start.alias("start"), stop.alias("stop")))).otherwise(F.array().cast(spans))
        return F.struct((stop + 1).alias("pos"), F.concat(acc["spans"], own).alias("spans"))

    zero = F.struct(F.col("start").alias("pos"), F.array().cast(spans).alias("spans"))
    views = views.withColumn("rendered", F.array_join(F.transform("turns", piece), "")).withColumn("mask", F.aggregate("turns", zero, step)["spans"])
    return views.select(
        F.col("cid").alias(id_col),
        "part",
        "perspective",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.size("mask").cast("bigint").alias("n_own"),
        F.length("rendered").cast("bigint").alias("n_chars"),
        "start",
        "rendered",
        "mask",
    )
