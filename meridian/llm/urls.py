"""URL filter: a path-template tree a host, judged by smoothed labelled purity.

Host and path are cut from the url as text. Rules (suffix of a host, prefix of
a path) come first: the longest that fits decides. Urls under a rule are also
the labelled examples for the rest:

1. Segments of the path become template segments: a segment that looks like a
   value (digits, long hexadecimal, a long or mixed token) generalises to a
   wildcard at once; of the other literals under a node, those with less than
   ``min_support`` urls do, and all do where more than ``max_children`` remain.
   A node therefore has at most ``max_children`` + 2 branches, at every depth.
2. Counts of urls, and of those that a rule blocks or allows, roll up to
   templates: one partial aggregation a level, so a host that holds a third of
   all urls is summed where it is read.
3. Sibling branches with the same form below are merged when their labelled
   shares don't differ significantly (a two-proportion test against the
   neighbour in order of share, runs of neighbours being one branch).
4. A template's purity is its share of blocked examples, smoothed towards its
   host's, which is smoothed towards that of all urls. Templates of at least
   ``threshold`` are rejected; urls no rule fits get their template's verdict.

Nulls and urls without :// have empty host and path, and form a template of
their own. Repeated rows count as often as they occur. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WILDCARD = "*"
#: A segment of one of these forms is a value, not a name.
VALUE = r"^(?:.*[0-9].*|[0-9a-fA-F]{8,}|.{25,})$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url by the text alone."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return host, path


def parse_rule(rule: str) -> tuple[str, str]:
    """'example.com/en/7' is (host, path prefix)."""
    host, slash, path = rule.partition("/")
    return host, slash + path


def matched_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        suffix, prefix = parse_rule(rule)
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def first_template(path: Column) -> Column:
    """Segments of the path; values are wildcards, a trailing slash is no segment."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike(VALUE), F.lit(WILDCARD)).otherwise(s))


def templates(paths: DataFrame, max_depth: int, min_support: int, max_children: int) -> DataFrame:
    """(host, segments, template) for each distinct host and segments, one level of the tree at a time."""
    tree = paths.withColumn("template", F.array().cast("array<string>"))
    for depth in range(max_depth):
        segment = F.get(F.col("segments"), F.lit(depth))
        named = tree.where(F.size("segments") > depth).where(segment != WILDCARD)
        children = named.groupBy("host", "template", segment.alias("name")).agg(F.sum("n").alias("n")).where(F.col("n") >= min_support)
        order = Window.partitionBy("host", "template").orderBy(F.desc("n"), "name")
        kept = children.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_children + 1)
        kept = kept.withColumn("width", F.max("place").over(Window.partitionBy("host", "template"))).where(F.col("width") <= max_children)
        kept = kept.select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("name").alias("s"))
        seen = F.coalesce(segment, F.lit(""))
        tree = tree.join(kept, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (seen == F.col("s")), "left")
        step = F.when(F.size("segments") > depth, F.concat("template", F.array(F.coalesce("s", F.lit(WILDCARD))))).otherwise(F.col("template"))
        tree = tree.withColumn("template", step).drop("h", "t", "s")
    deep = F.size("segments") > max_depth
    return tree.withColumn("template", F.when(deep, F.concat("template", F.array(F.lit("**")))).otherwise(F.col("template")))


def merged(nodes: DataFrame, z: float) -> DataFrame:
    """Siblings of the same form whose shares don't differ become one branch.

    nodes: host, template, n, blocked, labelled. Adds branch: the last literal
    of the template gives way to the names that merged.
    """
    place = F.size("template") - F.coalesce(F.nullif(F.array_position(F.reverse(F.transform("template", lambda s: (~s.isin(WILDCARD, "**")).cast("string"))), "true"), F.lit(0)), F.size("template") + 1) + 1
    form = F.transform("template", lambda s, i: F.when(i + 1 == F.col("place"), F.lit("?")).otherwise(s))
    nodes = nodes.withColumn("place", place).withColumn("form", form).withColumn("share", (F.col("blocked") + 0.5) / (F.col("labelled") + 1.0))
    order = Window.partitionBy("host", "form").orderBy("share", "template")
    last = lambda c: F.lag(c).over(order)
    pooled = (F.col("blocked") + last("blocked") + 0.5) / (F.col("labelled") + last("labelled") + 1.0)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / (F.col("labelled") + 1.0) + 1 / (last("labelled") + 1.0)))
    apart = F.coalesce(((F.col("share") - last("share")) > z * spread).cast("int"), F.lit(0))
    nodes = nodes.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order))
    group = Window.partitionBy("host", "form", "run")
    for name in ("n", "blocked", "labelled"):
        nodes = nodes.withColumn(f"run_{name}", F.sum(name).over(group))
    return nodes


def judge(pages: DataFrame, block: list[str], allow: list[str], threshold: float = 0.5, strength: float = 4.0, max_depth: int = 4, min_support: int = 20, max_children: int = 64, z: float = 1.96, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of pages."""
    host, path = split_url(F.col(url_column))
    urls = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", matched_rule(F.col("host"), F.col("path"), [*block, *allow])).withColumn("segments", first_template(F.col("path")))
    blocked = F.coalesce(F.col("rule").isin(*block), F.lit(False)).cast("long")
    labelled = F.col("rule").isNotNull().cast("long")
    paths = urls.groupBy("host", "segments").agg(F.count("*").alias("n"), F.sum(blocked).alias("blocked"), F.sum(labelled).alias("labelled"))
    shaped = templates(paths, max_depth, min_support, max_children)
    counts = ["n", "blocked", "labelled"]
    nodes = merged(shaped.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in counts)), z)
    hosts = nodes.groupBy("host").agg(F.sum("blocked").alias("host_blocked"), F.sum("labelled").alias("host_labelled"))
    world = hosts.agg(((F.sum("host_blocked") + 1.0) / (F.sum("host_labelled") + 2.0)).alias("prior"))
    nodes = nodes.join(hosts, "host").join(F.broadcast(world))  # one row
    prior = (F.col("host_blocked") + strength * F.col("prior")) / (F.col("host_labelled") + strength)
    purity = (F.col("run_blocked") + strength * prior) / (F.col("run_labelled") + strength)
    verdicts = nodes.select("host", "template", F.concat(F.lit("/"), F.array_join("form", "/")).alias("form"), purity.alias("purity"))
    known = shaped.select("host", "segments", "template").join(verdicts, ["host", "template"]).drop("template")
    out = urls.join(known, ["host", "segments"], "left")
    by_rule = F.when(F.col("rule").isin(*block), "block").when(F.col("rule").isNotNull(), "allow")
    by_method = F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_method).alias("verdict"), F.col("form").alias("template"), "purity")
