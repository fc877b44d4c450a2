"""URL filter by a tree of path templates. DataFrame functions only.

URLs become distinct (host, path) rows with counts. Level by level, a path's segment becomes part
of its template: runs of digits are replaced by `#` and long hexadecimal names by `%`; and where a
node of the tree has many different children that rarely repeat, they are one wildcard `*`. Then
sibling branches are merged into `+` if they look alike: the same depth and leading template below
them, and shares of blocked, allowed and unlabelled URLs that do not differ from those of all such
siblings by a z-test. A template's purity is its share of blocked URLs among the labelled ones,
smoothed by STRENGTH URLs of the overall share; templates of at least BLOCK_PURITY are rejected,
however few of their URLs are labelled, but not those without any label.

Labels are the verdicts of given rules (host, path), or come with the input. A rule's own verdict
always stands: it fits its host and all subdomains if the path starts with the rule's; the longest
rule wins.

Hot hosts: all counts are combined map-side; tables of nodes are written, so that joins with them
are broadcast only under Spark's limit, else split by adaptive execution. Depth has no limit: levels
are taken while a node has more than MANY paths below it, as no other can have so many children, and
merged while a host has two templates so deep. Plans are cut every LEVELS levels.

Defined results: a null url, or one without ://, has an empty host and path, for which no rule
holds. Repeated rows and null page_ids are rows of their own; an empty table gives an empty result.
Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import materialise, table

MANY, RARE, LEVELS = 20, 0.3, 6
STRENGTH, BLOCK_PURITY, Z = 5.0, 0.9, 3.0

#: verdict, host, path
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; both null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _plain(segment: Column) -> Column:
    hexed = F.regexp_replace(segment, r"(?i)\b(?=[0-9a-f-]*[0-9])[0-9a-f-]{12,}\b", "%")
    return F.regexp_replace(hexed, r"[0-9]+", "#")


def templates(urls: DataFrame, many: int = MANY, rare: float = RARE) -> DataFrame:
    """host, path, n, blocked, allowed and template (an array of segments) of each distinct (host, path) of urls (host, path, label)."""
    one = lambda says: F.count_if(F.col("label") == says)
    paths = urls.groupBy("host", "path").agg(F.count("*").alias("n"), one("block").alias("blocked"), one("allow").alias("allowed"))
    segments = F.transform(F.filter(F.split("path", "/", -1), lambda s: s != ""), _plain)
    tree = materialise(paths.withColumns({"segments": segments, "node": F.array().cast("array<string>")}), "paths")
    i = 0
    while True:
        tree = tree.withColumn("segment", F.get("segments", F.lit(i)))
        children = tree.filter(F.col("segment").isNotNull()).groupBy("host", "node", "segment").agg(F.sum("n").alias("n"), F.count("*").alias("paths"))
        nodes = children.groupBy("host", "node").agg(F.count("*").alias("children"), F.sum("n").alias("urls"), F.sum("paths").alias("paths"))
        nodes = materialise(nodes.filter(F.col("paths") > many).drop("paths"), "varies")
        if nodes.isEmpty():  # no node from here on can have so many children
            break
        wide = nodes.filter((F.col("children") > many) & (F.col("children") > rare * F.col("urls"))).select("host", "node", F.lit(True).alias("varies"))
        tree = tree.join(wide, ["host", "node"], "left")
        step = F.when(F.col("segment").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.when(F.col("varies"), F.lit("*")).otherwise(F.col("segment"))))
        tree = tree.withColumn("node", F.concat("node", step)).drop("varies", "segment")
        i += 1
        if i % LEVELS == 0:
            tree = materialise(tree, "levels")
    rest = F.when(F.size("segments") > i, F.slice("segments", F.lit(i + 1), F.size("segments"))).otherwise(F.array().cast("array<string>"))
    return materialise(tree.withColumn("template", F.concat("node", rest)).drop("segments", "segment", "node"), "tree")


def merged(tree: DataFrame, z: float = Z) -> DataFrame:
    """tree with the segments of branches that look like their siblings replaced by `+`, level by level."""
    sizes = tree.groupBy("host", "template").agg(F.size("template").alias("size")).groupBy("host", "size").agg(F.count("*").alias("n"))
    two = F.sum("n").over(Window.partitionBy("host").orderBy(F.desc("size"))) >= 2
    deepest = sizes.withColumn("two", two).filter("two").agg(F.max("size")).first()[0] or 0
    for i in range(deepest):
        inner = F.size("template") > i
        keyed = tree.withColumns({"up": F.when(inner, F.slice("template", 1, i)), "branch": F.when(inner, F.get("template", F.lit(i))), "below": F.when(inner, F.expr(f"slice(template, {i + 2}, size(template))"))})
        shapes = keyed.filter("branch IS NOT NULL").groupBy("host", "up", "branch", "below").agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "allowed")))
        branches = shapes.groupBy("host", "up", "branch").agg(
            F.max(F.struct("n", F.to_json("below").alias("below"))).alias("most"), F.max(F.size("below")).alias("depth"), *(F.sum(c).alias(c) for c in ("n", "blocked", "allowed"))
        ).withColumn("shape", F.struct(F.col("most.below").alias("below"), "depth"))
        branches = materialise(branches.select("host", "up", "branch", "shape", "n", "blocked", "allowed"), "branches")
        alike = branches.groupBy("host", "up", "shape").agg(F.count("*").alias("siblings"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "blocked", "allowed"))).filter("siblings > 1")
        both = branches.join(materialise(alike, "alike"), ["host", "up", "shape"])

        def near(c: str) -> Column:
            share = F.col(f"all_{c}") / F.col("all_n")
            return F.abs(F.col(c) / F.col("n") - share) <= z * F.sqrt(share * (1 - share) / F.col("n"))

        merge = both.filter(near("blocked") & near("allowed")).select("host", "up", "branch", F.lit(True).alias("merges"))
        tree = keyed.join(materialise(merge, "merges"), ["host", "up", "branch"], "left").withColumn(
            "template", F.when(F.col("merges"), F.concat("up", F.array(F.lit("+")), "below")).otherwise(F.col("template"))
        ).drop("up", "branch", "below", "merges")
        if (i + 1) % LEVELS == 0:
            tree = materialise(tree, "levels")
    return tree


def judged(tree: DataFrame, strength: float = STRENGTH, purity: float = BLOCK_PURITY) -> DataFrame:
    """host, path, template as a string, purity, rejected."""
    tree = materialise(tree.select("host", "path", "n", "blocked", "allowed", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template")), "merged")
    blocked, allowed = tree.agg(F.sum("blocked"), F.sum("allowed")).first()
    overall = (blocked or 0) / max(1, (blocked or 0) + (allowed or 0))
    sums = tree.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "allowed")))
    known = F.col("blocked") + F.col("allowed")
    rated = sums.withColumn("purity", (F.col("blocked") + F.lit(strength * overall)) / (known + F.lit(float(strength))))
    rated = rated.select("host", "template", "purity", ((F.col("purity") >= purity) & (known > 0)).alias("rejected"))
    return tree.select("host", "path", "template").join(materialise(rated, "rated"), ["host", "template"])


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of pages."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, label = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "label": label})
    verdicts = materialise(judged(merged(templates(rows))), "verdicts")
    method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(verdicts, ["host", "path"]).select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "template", "purity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)
