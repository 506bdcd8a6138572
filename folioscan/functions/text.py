"""Column functions over text: all run inside the JVM, none needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions import patterns as P

SPACE = r"(?U)\s+"
_CODE_BEFORE_COMMENT = r"^([^%\\]*+(?:\\.[^%\\]*+)*+\\?)"
_VERBATIM_BEGIN, _VERBATIM_END = (rf"\\{side}\{{{P.one_of(P.VERBATIM)}\}}" for side in ("begin", "end"))


def replace_all(text: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(text, pattern, to)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of all matches' group; null text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def has(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs; false for null."""
    return F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False))


def compact(text: Column) -> Column:
    """Null-safe: runs of white space become one space, ends are trimmed."""
    return F.trim(replace_all(F.coalesce(text, F.lit("")), SPACE, " "))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use refers to it: without this, chained functions that
    mention their input twice would double the expression at every link."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def text_lines(text: Column) -> Column:
    """Lines without their ends; a final line end adds no empty line."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return let(F.split(F.coalesce(text, F.lit("")), r"\R"), cut)


def code_line(line: Column) -> Column:
    """A source line up to its first unescaped percent sign."""
    return F.regexp_extract(line, _CODE_BEFORE_COMMENT, 1)


def strip_comments(text: Column) -> Column:
    """Source text without comments. Lines of verbatim-like environments stay whole, nested ones counted by depth; the
    fold that counts runs only for texts that have such an environment."""

    def step(acc: Column, line: Column) -> Column:
        begins = has(line, _VERBATIM_BEGIN)
        ends = ~begins & (acc["depth"] > 0) & has(line, _VERBATIM_END)
        depth = acc["depth"] + F.when(begins, 1).when(ends, -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.concat(acc["out"], F.array(F.when(begins | (acc["depth"] > 0), line).otherwise(code_line(line)))).alias("out"))

    def strip(whole: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))
        rows = text_lines(whole)
        return F.array_join(F.when(has(whole, _VERBATIM_BEGIN), F.aggregate(rows, start, step)["out"]).otherwise(F.transform(rows, code_line)), "\n")

    return let(text, strip)


def bare_line(text: Column) -> Column:
    """Commands with their option and braces removed, white space compacted."""
    return compact(replace_all(text, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?|[{}]"))


def one_line(text: Column) -> Column:
    """The same without comments."""
    return bare_line(strip_comments(text))


def snippet(text: Column) -> Column:
    """Comments removed, white space compacted, commands kept."""
    return compact(strip_comments(text))


def payloads(text: Column, pattern: str, limit: int | None = None) -> Column:
    """Cleaned first groups of all matches, without footnote commands in them."""
    found = F.transform(find_all(text, pattern, 1), lambda p: one_line(replace_all(p, P.THANKS)))
    return found if limit is None else F.slice(found, 1, limit)


def matches(text: Column, pattern: str) -> Column:
    """Array of structs (line_no, match): every match with the 1-based line it starts on, in one pass of the text."""
    steps = find_all(text, rf"\G(?s:.*?)(?:{pattern})")
    found = find_all(text, rf"\G(?s:.*?)({pattern})", 1)
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    zipped = F.arrays_zip(steps.alias("step"), found.alias("match"))
    none = F.array().cast("array<struct<line_no:int,match:string>>")

    def walk(acc: Column, z: Column) -> Column:
        after = acc["n"] + newlines(z["0"])
        item = F.struct((after - newlines(z["1"]) + 1).cast("int").alias("line_no"), z["1"].alias("match"))
        return F.struct(after.cast("int").alias("n"), F.concat(acc["out"], F.array(item)).alias("out"))

    named = F.transform(zipped, lambda z: F.struct(z["step"].alias("0"), z["match"].alias("1")))
    return F.aggregate(named, F.struct(F.lit(0).alias("n"), none.alias("out")), walk)["out"]


def split_cells(row: Column) -> Column:
    """Cells of a table row: split at ampersands behind an even number of backslashes, which stay in the left cell."""
    # a row that ends in an open escape must not swallow the closing mark
    closed = lambda r: F.concat(r, F.when(has(r, r"(?<!\\)(?:\\\\)*\\$"), F.lit(" ")).otherwise(F.lit("")), F.lit("&"))
    return find_all(let(row, closed), r"([^&\\]*+(?:\\.[^&\\]*+)*+)&", 1)


def cell_text(cell: Column) -> Column:
    """A table cell as it reads: rules removed, escaped ampersands freed, cleaned. Its row has no comment any more."""
    bare = replace_all(cell, r"\\(?:toprule|midrule|bottomrule|hline)\b")
    bare = replace_all(bare, r"\\(?:cmidrule|cline)(?:\([^)]*\))?\{[^{}]*\}")
    return bare_line(F.replace(bare, F.lit("\\&"), F.lit("&")))


def _number(raw: Column) -> Column:
    clean = F.replace(replace_all(raw, r"%$"), F.lit(","), F.lit(""))
    decimals = F.length(F.regexp_extract(clean, r"\.(\d+)$", 1))
    return F.struct(clean.try_cast("double").alias("value"), raw.alias("text"), decimals.alias("decimals"))


def first_number(cell: Column) -> Column:
    """Struct (value, text, decimals) of the first number in the cell, null if there is none."""
    raw = F.regexp_extract(cell, f"({P.NUMBER})", 1)
    return F.when(raw != "", _number(raw))


def all_numbers(line: Column) -> Column:
    """Array of such structs for all numbers of the line."""
    return F.transform(find_all(line, P.NUMBER), _number)


def number_text(value: Column, decimals: Column) -> Column:
    """Fixed point with as many decimals as asked for, 2 at least and 4 at most."""
    return _fixed(value, decimals, "0.", "")


def signed_text(value: Column, decimals: Column) -> Column:
    """The same with a sign in front."""
    return _fixed(value, decimals, "+0.", "-0.")


def _fixed(value: Column, decimals: Column, plus: str, minus: str) -> Column:
    def shape(n: int) -> str:
        return plus + "0" * n + (";" + minus + "0" * n if minus else "")

    pattern = lambda n: F.call_function("format_number", value, F.lit(shape(n)))
    return F.when(decimals >= 4, pattern(4)).when(decimals == 3, pattern(3)).otherwise(pattern(2))


def tolerance(decimals: Column) -> Column:
    """Half a unit of the last printed decimal."""
    return F.lit(0.5) * F.pow(F.lit(10.0), -F.greatest(decimals, F.lit(0)))


def gap(reported: Column, computed: Column) -> Column:
    """Struct (tier, gap_abs, gap_rel): how far a printed value is from the recomputed one."""
    far = F.abs(reported - computed)
    share = far / F.greatest(F.abs(computed), F.lit(1e-9)) * 100
    tier = F.when((far >= 2.0) | (share >= 5.0), "deterministic").when((far >= 0.5) | (share >= 1.0), "likely_error").otherwise("ambiguous")
    return F.struct(tier.alias("tier"), far.alias("gap_abs"), share.alias("gap_rel"))


def row_label(line: Column, ends: str = r"(?U)^\s+|\s+$", gaps: str = r"(?U)\s{2,}") -> Column:
    """Text in front of the line's first number, without a leading row number; a fixed phrase if nothing is left. ends
    and gaps: the white space that is cut off and that becomes one space."""
    # places of regexp_instr are in UTF-16 units, so the number itself is looked for
    first = F.regexp_extract(line, f"({P.NUMBER})", 1)
    front = replace_all(F.when(first != "", F.substr(line, F.lit(1), F.instr(line, first) - 1)).otherwise(line), ends)
    front = replace_all(replace_all(front, gaps, " "), r"^\d+\s+")
    return F.coalesce(F.nullif(front, F.lit("")), F.lit("(row label unavailable)"))


def exact_text(value: Column) -> Column:
    """Fixed point with four decimals of the double's whole binary value, as printf gives it, up to 2 ** 116 in size;
    the shortest digits that number_text prints are others from 2 ** 39 on."""
    size = F.abs(value)
    high = F.floor(size / F.lit(2.0**62))
    low = (size - high.cast("double") * F.lit(2.0**62)).cast("bigint")
    whole = (high.cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast("string")
    # from 2 ** 53 on there is no fraction
    rest = F.when(size < 2.0**53, F.substr(number_text(size - F.floor(size).cast("double"), F.lit(4)), F.lit(2))).otherwise(".0000")
    return F.when((size < 2.0**39) | (size >= 2.0**116), number_text(value, F.lit(4))).otherwise(F.concat(F.when(value < 0, "-").otherwise(""), whole, rest))


def group_tags(line: Column, tags=P.GROUP_TAGS) -> Column:
    """Upper-cased parenthesised group tags of a header line, in order."""
    return F.transform(find_all(line, rf"(?i)\(\s*({'|'.join(tags)})\s*\)", 1), F.upper)


def summary_positions(line: Column) -> Column:
    """Positions of summary columns among the numbers that follow, counted from 0; empty if this is no header."""
    tokens = find_all(line, P.HEADER_TOKEN)
    bare = F.transform(tokens, lambda t: F.lower(replace_all(t, r"^\.+|\.+$")))
    labels = F.array(*[F.lit(w) for w in P.HEADER_LABELS])
    sums = F.array(*[F.lit(w) for w in P.HEADER_SUMMARY_TOKENS])
    first_other = F.array_position(F.transform(bare, lambda t: F.array_contains(labels, t)), F.lit(False)) - 1
    leading = F.when(first_other < 0, F.size(bare)).otherwise(first_other)
    at = F.transform(bare, lambda t, i: F.when(F.array_contains(sums, t), i - leading))
    ok = ~has(line, P.NUMBER) & ~has(line, P.HEADER_STOP) & has(line, P.HEADER_SUMMARY) & (F.size(tokens) >= 4)
    return F.when(ok, F.filter(at, lambda i: i >= 0).cast("array<int>")).otherwise(F.array().cast("array<int>"))


def path_depth(path: Column, root: Column) -> Column:
    """Parts of the path below root, 99 outside it."""
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(inside, F.size(F.split(F.substr(path, F.length(root) + 2), "/"))).otherwise(F.lit(99))


def words(text: Column) -> Column:
    """Number of words, letters and digits of any script."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\b\w+\b")), F.lit(0)).cast("bigint")


def citation_marks(text: Column) -> Column:
    """Citations in running text. Every shape has a bracket, so a text without any is not searched."""
    bracketed = F.contains(text, F.lit("[")) | F.contains(text, F.lit("("))
    return F.coalesce(F.when(bracketed, F.regexp_count(text, F.lit(P.CITATION_MARK))), F.lit(0)).cast("bigint")


def per_thousand(cites: Column, n_words: Column) -> Column:
    """Citation density as text with one decimal."""
    return F.call_function("format_number", cites / F.greatest(n_words, F.lit(1)) * 1000, F.lit("0.0"))


def label_tokens(label: Column) -> Column:
    """The first four tokens of three or more characters."""
    return F.slice(F.filter(find_all(label, r"[A-Za-z0-9][A-Za-z0-9_.+-]*"), lambda t: F.length(t) >= 3), 1, 4)


def positive(value: int, name: str = "limit") -> int:
    """The value if it is a positive whole number; raises ValueError otherwise."""
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise ValueError(f"{name} must be a positive integer")
    return value


def safe_stem(path: Column, default: str = "paper") -> Column:
    """A file name's stem with unsafe characters as underscores."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = replace_all(name, r"(?i)\.(?:pdf|tex)$")
    clean = replace_all(replace_all(stem, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(default))


def plain_text(source: Column) -> Column:
    """LaTeX source as readable text by a chain of replacements."""
    def heads(text: Column, pattern: str, make) -> Column:
        # each match is cleaned on its own: the text is split into steps that end in a match, and rebuilt
        def rebuild(whole: Column) -> Column:
            def one(step: Column) -> Column:
                return let(F.regexp_extract(step, rf"(?s)^(?:.*?)({pattern})\z", 1), lambda m: F.concat(F.substr(step, F.lit(1), F.length(step) - F.length(m)), make(m)))

            def join(steps: Column) -> Column:
                rest = F.substr(whole, F.aggregate(steps, F.lit(0), lambda n, s: n + F.length(s)) + 1)
                return F.concat(F.array_join(F.transform(steps, one), ""), rest)

            return let(find_all(whole, rf"\G(?s:.*?)(?:{pattern})"), join)

        return let(text, rebuild)

    text = strip_comments(source)
    text = heads(text, P.TITLE, lambda m: F.concat(F.lit("\n\n# TITLE: "), one_line(F.regexp_extract(m, P.TITLE, 1)), F.lit("\n")))
    text = replace_all(replace_all(text, r"\\begin\{abstract\}", "\n\n## ABSTRACT\n"), r"\\end\{abstract\}", "\n")
    floats = "|".join(P.FLOATS)
    text = replace_all(text, rf"\\begin\{{({floats})[*]?\}}", "\n[$1]\n")
    text = replace_all(text, rf"\\end\{{(?:{floats})[*]?\}}", "\n")
    text = heads(text, P.SECTION_COMMAND, lambda m: F.concat(F.lit("\n\n## "), F.upper(F.regexp_extract(m, P.SECTION_COMMAND, 1)), F.lit(": "), one_line(F.regexp_extract(m, P.SECTION_COMMAND, 2)), F.lit("\n")))
    text = heads(text, P.CAPTION, lambda m: F.concat(F.lit("\nCAPTION: "), one_line(F.regexp_extract(m, P.CAPTION, 1)), F.lit("\n")))
    text = replace_all(text, r"\\item(?:\[[^\]]*\])?", "\n- ")
    styled = P.command(P.STYLES, P.BRACED)
    text = heads(text, styled, lambda m: one_line(F.regexp_extract(m, styled, 1)))
    text = replace_all(text, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?", " ")
    text = replace_all(replace_all(replace_all(text, r"[{}]"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return replace_all(text, r"(?U)^\s+|\s+$")
