"""Document projects: files, entry points, includes, bibliographies, names and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions import patterns as P
from folioscan.functions import text as T
from folioscan.sources.shared import remove, written

# Names that tell a project's layout.
MAIN_NAMES = ("main.tex", "paper.tex", "ms.tex", "manuscript.tex")
SIDE_NAMES = "appendix|supp|supplement|rebuttal|response"
MARKERS = (".git", ".latexmkrc", "latexmkrc", "Makefile", "makefile")
RESOURCES = ("bib", "bibs", "bibliography", "references", "figures", "figure", "fig", "tables", "sections")
CONTAINERS = ("src", "tex", "source", "sources", "latex", "paper")
FALLBACK_BIBLIOGRAPHIES = 20


def read_files(spark: SparkSession, root: str, pattern: str = "*.tex") -> DataFrame:
    """(path, text, had_replacement): files below root whose name fits, decoded as UTF-8 with replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    text = F.expr("make_valid_utf8(cast(content AS string))")
    path = F.regexp_replace("path", "^[a-z]+:/+(?=/)|^[a-z]+:(?=/[^/])", "")
    return files.select(path.alias("path"), text.alias("text")).withColumn("had_replacement", F.contains("text", F.lit("�")))


def read_json(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """One row per directory (bundle_id) with a text column for each named JSON file, null where it is missing."""
    files = read_files(spark, root, "*.json").withColumn("name", F.regexp_extract("path", r"([^/]+)\.json$", 1)).withColumn("bundle_id", F.regexp_extract("path", r"^(.*)/[^/]+$", 1))
    return files.groupBy("bundle_id").pivot("name", names).agg(F.first("text"))


def read_html(spark: SparkSession, root: str) -> DataFrame:
    """(path, html) of the pages below root."""
    return read_files(spark, root, "*.html").select("path", F.col("text").alias("html"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def normal_path(path: Column) -> Column:
    """The path without empty, current and parent steps."""
    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(part == "..", up).when(part.isin("", "."), acc).otherwise(F.concat(acc, F.array(part)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def is_within(path: Column, root: Column) -> Column:
    """Whether the normalised path is root or lies below it."""
    clean = normal_path(path)
    return (clean == root) | F.startswith(clean, F.concat(root, F.lit("/")))


def project_roots(listing: DataFrame) -> DataFrame:
    """(path, root) for the files of a listing(path, is_dir): the directory above a container directory, above one with
    a marker, a resource directory or sources beside it, else the file's own directory."""
    files = listing.where("NOT is_dir").select("path", parent(F.col("path")).alias("own")).withColumn("above", parent(F.col("own")))
    entries = listing.select(parent(F.col("path")).alias("above"), base_name(F.col("path")).alias("name"), "is_dir")
    hint = entries.where(F.col("name").isin(*MARKERS) | (F.col("is_dir") & F.col("name").isin(*RESOURCES)) | (~F.col("is_dir") & F.endswith("name", F.lit(".tex"))))
    hinted = files.join(hint.select("above").distinct().withColumn("hint", F.lit(True)), "above", "left")
    root = F.when(F.col("above") == "", F.col("own")).when(F.lower(base_name(F.col("own"))).isin(*CONTAINERS) | F.col("hint"), F.col("above")).otherwise(F.col("own"))
    return hinted.select("path", root.alias("root"))


def entry_score(path: Column, depth: Column, text: Column) -> Column:
    """The lower, the likelier is the file a project's entry."""
    name = F.lower(base_name(path))
    part = lambda ok, n: F.when(ok, n).otherwise(0)
    return part(name.isin(*MAIN_NAMES), -100) + part(depth == 1, -20) + part(F.contains(text, F.lit("\\begin{document}")), -10) + part(F.contains(text, F.lit("\\documentclass")), -5) + part(T.has(name, SIDE_NAMES), 30)


def best_candidate(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The first row of every group in order: one grouped minimum, no window."""
    rest = [c for c in rows.columns if c not in (group, *order)]
    best = rows.groupBy(group).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(group, *[F.col(f"_b.{c}").alias(c) for c in (*order, *rest)])


def entry_files(files: DataFrame) -> DataFrame:
    """(root, path, others, warning) from files(root, path, text): the best standalone file of each project, or all of
    its files where none is standalone. others counts the rest; the warning names at most five of them."""
    standalone = F.contains("text", F.lit("\\documentclass")) | F.contains("text", F.lit("\\begin{document}"))
    depth = T.path_depth(F.col("path"), F.col("root"))
    ranked = files.select("root", "path", standalone.alias("standalone"), depth.alias("depth"), entry_score(F.col("path"), depth, F.col("text")).alias("score"))
    window = Window.partitionBy("root")
    by = F.when(F.col("standalone"), 0).otherwise(1)
    ranked = ranked.withColumn("candidates", F.sum(F.col("standalone").cast("int")).over(window)).withColumn("i", F.row_number().over(window.orderBy(by, "score", "depth", "path")))
    near = F.collect_list(F.when(F.col("standalone") & F.col("i").between(2, 6), F.col("path"))).over(window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumn("near", near).where("candidates = 0 OR i = 1")
    warning = F.when(F.col("candidates") == 0, F.lit("no standalone file: all are used")).when(F.col("candidates") > 1, F.concat(F.lit("other candidates: "), F.array_join("near", ", ")))
    return ranked.select("root", "path", F.when(F.col("candidates") > 0, F.col("candidates") - 1).otherwise(0).alias("others"), warning.alias("warning"))


def _sorted(table: DataFrame) -> DataFrame:
    """table as the side of a join that is sorted, never broadcast: tables of files and places grow with the input, and
    paths compress so well that their size on disk says little about the room they take in the driver."""
    return table.hint("merge")


def include_edges(files: DataFrame) -> DataFrame:
    """(root, src, ord, dst, status): includes in order of appearance. dst is the target, with the source suffix added
    where that file exists; status is ok, missing or outside."""
    text = F.col("text")
    plain, folder, inner = (T.find_all(text, P.INCLUDE, g) for g in (1, 2, 3))
    target = F.zip_with(plain, F.zip_with(folder, inner, lambda a, b: F.concat(a, F.lit("/"), b)), lambda p, q: F.when(p != "", p).otherwise(q))
    edges = files.select("root", F.col("path").alias("src"), F.posexplode(target).alias("ord", "target"))
    whole = F.when(F.startswith("target", F.lit("/")), F.col("target")).otherwise(F.concat(parent(F.col("src")), F.lit("/"), F.col("target")))
    edges = edges.withColumn("whole", normal_path(whole))
    options = F.array_distinct(F.array(F.col("whole"), F.regexp_replace("whole", r"\.[^./]*$", ".tex"), F.concat("whole", F.lit(".tex"))))
    tries = edges.select("*", F.posexplode(options).alias("k", "dst"))
    known = files.select("root", F.col("path").alias("dst"), F.lit(True).alias("found"))
    tries = tries.join(_sorted(known), ["root", "dst"], "left").withColumn("inside", is_within(F.col("dst"), F.col("root")))
    good = F.coalesce(F.col("found") & F.col("inside"), F.lit(False))
    best = tries.groupBy("root", "src", "ord", "whole").agg(F.min(F.when(good, F.struct("k", "dst")))["dst"].alias("dst"), F.max(F.when(F.col("k") == 0, F.col("inside"))).alias("inside"))
    status = F.when(F.col("dst").isNotNull(), "ok").when(F.col("inside"), "missing").otherwise("outside")
    return best.select("root", "src", "ord", F.coalesce("dst", "whole").alias("dst"), status.alias("status"))


#: Jumps may be so many times as many as edges and reached nodes together.
JUMPS = 2


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): every node that a root of roots(root) reaches over edges(src, dst), once, with the fewest
    steps; cycles end, and neither the depth nor the number of edges is bounded.

    Every round follows jumps from the nodes that the last one found. Jumps start as the edges and join to twice their
    length while they stay few, so a deep graph takes a logarithmic number of rounds and a dense one no more room than
    its result.
    """
    spark = edges.sparkSession
    jumps, jumps_at = written(edges.select("src", "dst").distinct().where("src <> dst").withColumn("steps", F.lit(1)), "jumps")
    reached, reached_at = written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "reached")
    front, front_at, n_edges, n_jumps, n_reached = reached, None, (n := jumps.count()), n, reached.count()
    while True:
        steps = front.join(jumps, front["node"] == jumps["src"]).select("root", F.col("dst").alias("node"), (F.col("depth") + F.col("steps")).alias("depth"))
        new, new_at = written(steps.groupBy("root", "node").agg(F.min("depth").alias("depth")).join(reached, ["root", "node"], "left_anti"), "front")
        found = new.count()
        if front_at:
            remove(spark, front_at)
        if not found:
            remove(spark, jumps_at)
            remove(spark, new_at)
            return reached
        whole, whole_at = written(reached.unionByName(new), "reached")
        remove(spark, reached_at)
        reached, reached_at, front, front_at, n_reached = whole, whole_at, new, new_at, n_reached + found
        if n_jumps <= JUMPS * (n_edges + n_reached) and _pairs(jumps) <= 2 * JUMPS * (n_edges + n_reached):
            a, b = jumps.alias("a"), jumps.alias("b")
            twice = a.join(b, F.col("a.dst") == F.col("b.src")).where("a.src <> b.dst").select("a.src", "b.dst", (F.col("a.steps") + F.col("b.steps")).alias("steps"))
            longer, longer_at = written(jumps.unionByName(twice).groupBy("src", "dst").agg(F.min("steps").alias("steps")), "jumps")
            remove(spark, jumps_at)
            jumps, jumps_at, n_jumps = longer, longer_at, longer.count()


def _pairs(jumps: DataFrame) -> int:
    """How many pairs of jumps meet in a node."""
    into, out = jumps.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("a")), jumps.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("b"))
    return into.join(out, "node").agg(F.sum(F.col("a").cast("decimal(38,0)") * F.col("b"))).first()[0] or 0


def include_order(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, place, repeated): the files of every entry in reading order, at every include of a file that is
    read; a file's later places are repeats and stand for nothing. Places compare as arrays of positions, which is the
    depth-first order.

    A file is read at its smallest place. Every round lengthens the places that have become smaller by one include and
    keeps the smallest of each file, so the rounds grow with the depth and the rows with the files, not with the paths.
    """
    spark = edges.sparkSession
    links, _ = written(edges.where("status = 'ok'").select("src", "ord", "dst"), "links")
    known, known_at = written(roots.select("root", F.col("root").alias("node"), F.array(F.lit(0)).alias("place")).distinct(), "places")
    moved, moved_at = known, None
    longer = lambda rows: rows.join(_sorted(links), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.concat("place", F.array("ord")).alias("place"))
    while True:
        least = longer(moved).groupBy("root", "node").agg(F.min("place").alias("place"))
        before = known.select("root", "node", F.col("place").alias("old"))
        better, better_at = written(least.join(_sorted(before), ["root", "node"], "left").where("old IS NULL OR place < old").select("root", "node", "place"), "moved")
        if moved_at:
            remove(spark, moved_at)
        if better.isEmpty():
            break
        whole, whole_at = written(known.join(_sorted(better.select("root", "node")), ["root", "node"], "left_anti").unionByName(better), "places")
        remove(spark, known_at)
        known, known_at, moved, moved_at = whole, whole_at, better, better_at
    sites = longer(known).unionByName(known.where(F.size("place") == 1))
    first = known.select("root", "node", F.col("place").alias("first"))
    return sites.distinct().join(_sorted(first), ["root", "node"]).select("root", "node", "place", (F.col("place") != F.col("first")).alias("repeated"))


def expanded(files: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, text): each entry's text with its includes inlined where they stand, once each; refused ones are empty.

    Every file is cut at its includes; pieces are placed by the path of positions that leads to them and put together
    in that order.
    """
    reads = include_order(edges, roots).where("NOT repeated").select("root", "node", "place")
    pieces = files.select(F.col("path").alias("node"), F.posexplode(F.split("text", P.INCLUDE)).alias("k", "piece"))
    # the piece after include k - 1 sorts behind everything below that include and before include k
    placed = reads.join(_sorted(pieces), "node").withColumn("at", F.concat(F.transform("place", lambda x: x * 2 + 1), F.array(F.col("k") * 2)))
    joined = placed.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return joined.select("root", F.array_join(F.col("p.piece"), "\n").alias("text"))


def bibliographies(sources: DataFrame, listing: DataFrame) -> DataFrame:
    """(root, path, ord, status) from sources(root, path, text) and listing(root, path): named bibliography files, or
    without any bibliography command the project's first ones by path."""
    named = sources.select("root", parent(F.col("path")).alias("base"), F.posexplode(F.flatten(F.transform(T.find_all(F.col("text"), P.BIBLIOGRAPHY, 1), lambda g: F.transform(F.split(g, ","), lambda k: F.trim(k))))).alias("ord", "name")).where("name <> ''")
    whole = normal_path(F.when(F.startswith("name", F.lit("/")), F.col("name")).otherwise(F.concat("base", F.lit("/"), "name")))
    bib = F.when(F.endswith("whole", F.lit(".bib")), F.col("whole")).otherwise(F.concat("whole", F.lit(".bib")))
    named = named.withColumn("whole", whole).withColumn("path", bib).join(listing.select("root", "path", F.lit(True).alias("found")), ["root", "path"], "left")
    status = F.when(~is_within(F.col("path"), F.col("root")), "outside").when(F.col("found"), "ok").otherwise("missing")
    named = named.select("root", "path", "ord", status.alias("status"))
    silent = sources.groupBy("root").agg(F.max(T.has(F.col("text"), P.BIBLIOGRAPHY)).alias("any")).where("NOT any")
    spare = listing.where(F.endswith("path", F.lit(".bib"))).join(silent, "root", "left_semi")
    spare = spare.withColumn("ord", F.row_number().over(Window.partitionBy("root").orderBy("path")) - 1).where(F.col("ord") < FALLBACK_BIBLIOGRAPHIES)
    return named.unionByName(spare.select("root", "path", "ord", F.lit("fallback").alias("status")))


def page_count(*answers: tuple[str, Column]) -> tuple[Column, Column]:
    """(count, source) of the first tool that knows the number of pages."""
    count = F.coalesce(*[c for _, c in answers])
    source = reduce(lambda rest, a: F.when(a[1].isNotNull(), a[0]).otherwise(rest), reversed(answers), F.lit(None).cast("string"))
    return count, source


def output_name(path: Column) -> Column:
    """A file name that is safe and tells sources of one name apart; repeatable, so without a random part."""
    return F.concat(T.safe_stem(path), F.lit("_"), F.left(F.sha1(F.encode(path, "UTF-8")), F.lit(6)))


def write_report(rows: DataFrame, path: str, force: bool = False) -> None:
    """Write a one-column frame as text; an existing place is an error unless forced."""
    rows.write.mode("overwrite" if force else "errorifexists").text(path)
