"""URL filtering by rules and, where no rule fits, by a tree of path templates for each host. DataFrame functions only.

Pages that a rule judges are the labelled ones. Numbers and ids are wildcards by their form. Other segments become
wildcards where their family, the segments that follow one place of a host, is open: at least half of its pages
have a segment that no other page has (the Good-Turing chance that the next one is new), and the segment
itself is on no more than the root of the family's pages. Branches of a family are then merged where they are
statistically similar to the family as a whole, by two-proportion tests: how often paths end there, how often a
wildcard follows, and how often labels say block (branches without labels can't differ in that). Merged branches
are one, with everything below them. Both decisions are taken twice, the second time under what the first has joined.

Nodes of the tree are the beginnings of the resulting templates and sum up labels. The purity of a template is the
share of blocked labels, smoothed down the tree: each level starts with ``SMOOTHING`` pseudo labels from the
estimate above it, drawn halfway back to one half, and pages without a label count as ``UNLABELLED`` of a
label at one half. A template is rejected at ``PURITY`` or more: only branches that hold blocked labels themselves, or
are merged with such, can be, and only if the labels are on about an eighth of their pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, spread_join, stored

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with its path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SMOOTHING, UNLABELLED, PURITY, Z, EVIDENCE = 2.0, 0.1, 0.8, 1.96, 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://`` or for null."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    part = lambda group: F.coalesce(F.regexp_extract(after, r"^([^/?#]*)([^?#]*)", group), F.lit(""))
    return ascii_lower(part(1)), part(2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Rules of one length go in order of text."""
    tests = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    return F.coalesce(*tests) if tests else F.lit(None).cast("struct<rule:string,verdict:string>")


def shapes(path: Column) -> Column:
    """Segments of a path; numbers, hexadecimal ids and segments too long for a name are wildcards by their form."""

    def general(s: Column) -> Column:
        return F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{id}")).when(F.length(s) > 40, F.lit("{slug}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)


def open_segment() -> Column:
    """A wildcard for rare segments of open families."""
    return F.when((F.col("f_rows") >= EVIDENCE) & (2 * F.col("f_single") >= F.col("f_rows")) & (F.col("rows") * F.col("rows") <= F.col("f_rows")), F.lit("{*}")).otherwise(F.col("own"))


def merged_segment() -> Column:
    """One name for all branches that don't differ from their family."""

    def alike(x: str, of: str) -> Column:
        rate = F.try_divide(F.col(f"f_{x}"), F.col(f"f_{of}"))
        spread = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1.0), of) + F.try_divide(F.lit(1.0), f"f_{of}")))
        return F.coalesce(F.abs(F.try_divide(x, of) - rate) <= Z * spread, F.lit(True))

    return F.when(alike("ends", "rows") & alike("opens", "rows") & alike("blocked", "labelled"), F.lit("{~}")).otherwise(F.col("own"))


def decided(paths: DataFrame, child: str, under: str, symbol: Column, out: str, salts: int) -> DataFrame:
    """Add the array ``out`` to paths (host, path, rows, blocked, labelled): ``symbol`` of each segment of ``child`` in the family of its place in ``under``.

    Totals of nodes and families meet their rows in up to ``salts`` tasks each, as one host may have most of the pages.
    """
    step = lambda s, i: F.struct(i.alias("depth"), s.alias("own"), F.xxhash64(F.slice(under, 1, i)).alias("family"), (i == F.size(child) - 1).alias("end"), F.coalesce(F.startswith(F.get(child, i + 1), F.lit("{")), F.lit(False)).alias("open"))
    steps = paths.select("host", "path", "rows", "blocked", "labelled", F.explode(F.transform(child, step)).alias("s")).select("host", "path", "rows", "blocked", "labelled", "s.*")
    family, sums = ["host", "depth", "family"], ["rows", "blocked", "labelled", "ends", "opens"]
    counted = steps.withColumns({"ends": F.when(F.col("end"), F.col("rows")).otherwise(0), "opens": F.when(F.col("open"), F.col("rows")).otherwise(0)})
    nodes = counted.groupBy(*family, "own").agg(*[F.sum(c).alias(c) for c in sums])
    totals = nodes.groupBy(*family).agg(*[F.sum(c).alias(f"f_{c}") for c in sums], F.count_if(F.col("rows") == 1).alias("f_single"))
    symbols = spread_join(nodes, totals, family, "own", salts).select(*family, "own", symbol.alias("symbol"))
    found = spread_join(steps.select("host", "path", *family[1:], "own"), symbols, [*family, "own"], "path", salts)
    whole = found.groupBy("host", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "symbol"))), lambda x: x["symbol"]).alias(out))
    return stored(paths.join(whole, ["host", "path"], "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>"))), "url-paths")


def path_templates(paths: DataFrame, salts: int = 64) -> DataFrame:
    """Add ``template``, an array of names and wildcards, to distinct paths (host, path, rows, blocked, labelled)."""
    paths = stored(paths.withColumn("shape", shapes(F.col("path"))), "url-paths")
    paths = decided(paths, "shape", "shape", open_segment(), "first", salts)
    paths = decided(paths, "shape", "first", F.when(F.startswith("own", F.lit("{")), F.col("own")).otherwise(open_segment()), "general", salts)
    paths = decided(paths, "general", "general", merged_segment(), "alike", salts)
    return decided(paths, "general", "alike", merged_segment(), "template", salts)


def template_purity(templates: DataFrame) -> DataFrame:
    """Add ``purity`` to a table (host, template, rows, blocked, labelled) with one row for each host and template."""
    prefixes = F.transform(F.sequence(F.lit(0), F.size("template")), lambda d: F.xxhash64(F.slice("template", 1, d)))
    steps = templates.select("host", "template", "rows", "blocked", "labelled", F.posexplode(prefixes).alias("depth", "node"))
    nodes = steps.groupBy("host", "depth", "node").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n"), F.sum("rows").alias("r"))
    down = F.sort_array(F.collect_list(F.struct("depth", "b", "n", "r")))
    weight = lambda s: F.lit(UNLABELLED) * (s["r"] - s["n"])
    purity = F.aggregate(down, F.lit(0.5), lambda p, s: (s["b"] + F.lit(SMOOTHING) * ((p + 0.5) / 2) + weight(s) * 0.5) / (s["n"] + F.lit(SMOOTHING) + weight(s)))
    return spread_join(steps.select("host", "template", "depth", "node"), nodes, ["host", "depth", "node"], "template").groupBy("host", "template").agg(purity.alias("purity"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, salts: int = 64) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page; one row for each row of pages.

    A null url or one without ``://`` has empty host and path, fits no rule and, having no labels, is allowed.
    Repeated rows are judged alike and each counts as a label. Rows of one host and path are spread over
    up to ``salts`` tasks. An empty table gives an empty result. Only page_id and url are read.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("match", matching_rule(F.col("host"), F.col("path"), RULES if rules is None else rules))
    judged = judged.select("page_id", "host", "path", "match.rule", F.col("match.verdict").alias("ruled"))
    paths = judged.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ruled") == "block").alias("blocked"), F.count("ruled").alias("labelled"))
    paths = path_templates(paths, salts)
    templates = paths.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("rows", "blocked", "labelled")])
    verdicts = spread_join(paths.select("host", "path", "template"), template_purity(templates), ["host", "template"], "path", salts)
    rejected = F.when(F.col("purity") >= PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return spread_join(judged.withColumn("row", F.xxhash64("page_id")), verdicts, ["host", "path"], "row", salts).select("page_id", "host", "path", "rule", F.coalesce("ruled", rejected).alias("verdict"), "template", "purity")
