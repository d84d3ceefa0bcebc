"""URL filters: fixed host and path rules, then a tree of path templates learnt per host.

At every node of a host's tree, segments that vary from page to page become a wildcard. Branches
of one shape whose share of bad pages does not differ statistically from that of the shape are
merged. A template whose smoothed share of good pages is too low is rejected, with all its pages.

Only built-in functions. Rows move with host, path and segments alone. A host may hold any share
of the pages: what is learnt is pre-aggregated, and joins back over salted keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.joins import salted_join
from lexspan.session import pin

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Templates:
    """Parameters.

    depth: levels of the tree; what lies deeper counts as one tail. A node varies if it has at least
    `children` different segments, and at most `pages_per_child` pages for each; a segment of it with
    at least `own_pages` pages and `own_percent` of the node's stays itself. z: standard errors
    within which branches are similar. prior: pages that the prior share counts as.
    threshold: least smoothed share of good pages. salts: parts of a hot key in joins.
    """

    depth: int = 4
    children: int = 8
    pages_per_child: int = 4
    own_pages: int = 5
    own_percent: int = 5
    z: float = 1.96
    prior: float = 5.0
    threshold: float = 0.5
    salts: int = 16


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct of verdict and rule; else null.

    A rule fits its host and all subdomains if the path starts with its path; of equally long ones
    the first listed wins.
    """
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, own, start in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(own + start).alias("rule"))).otherwise(found)
    return found


def add_templates(pages: DataFrame, how: Templates) -> DataFrame:
    """Add `template` to rows that have host, path and `_salt`."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = pages.withColumn("_segments", segments).withColumn("template", F.lit(""))
    for level in range(how.depth):
        rows = rows.withColumn("_segment", F.get("_segments", F.lit(level)))
        keys = ["host", "template", "_segment"]
        counts = rows.filter("_segment is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        nodes = counts.groupBy("host", "template").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        varies = (F.col("kinds") >= how.children) & (F.col("all") <= how.pages_per_child * F.col("kinds"))
        own = (F.col("n") >= how.own_pages) & (100 * F.col("n") >= how.own_percent * F.col("all"))
        salted = counts.withColumn("_salt", F.pmod(F.xxhash64("_segment"), F.lit(how.salts)).cast("int"))
        literal = (
            salted_join(salted, nodes, ["host", "template"], how.salts)
            .filter(~varies | own)
            .select(*keys, F.lit(True).alias("literal"))
        )
        step = F.when(F.col("literal"), F.col("_segment")).otherwise("*")
        rows = (
            salted_join(rows, literal, keys, how.salts)
            .withColumn(
                "template",
                F.when(F.col("_segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), step)),
            )
            .drop("literal", "_segment")
        )
        rows = pin(rows, "url-level")  # read twice in the next level
    tail = F.when(F.size("_segments") > how.depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return rows.withColumn("template", tail).drop("_segments")


def judge_templates(rows: DataFrame, how: Templates) -> DataFrame:
    """host, template, branch, purity and rejected for every template of rows with `bad` (may be null).

    `branch` is the shape of the template (literal segments as `+`) where it was merged with others
    of its shape, else the template.
    """
    stats = rows.groupBy("host", "template").agg(
        F.count("bad").alias("labelled"), F.count_if("bad").alias("n_bad"), F.count(F.lit(1)).alias("pages")
    )
    stats = stats.withColumn("shape", F.regexp_replace("template", r"/[^/*][^/]*", "/+"))
    shapes = stats.groupBy("host", "shape").agg(F.sum("labelled").alias("s_labelled"), F.sum("n_bad").alias("s_bad"))
    total = stats.agg(
        ((F.sum("labelled") - F.sum("n_bad") + 1) / (F.sum("labelled") + 2)).alias("share")
    )
    salted = stats.withColumn("_salt", F.pmod(F.xxhash64("template"), F.lit(how.salts)).cast("int"))
    share = F.col("s_bad") / F.greatest(F.col("s_labelled"), F.lit(1))
    spread = F.sqrt(share * (1 - share) / F.greatest(F.col("labelled"), F.lit(1)))
    differs = F.abs(F.col("n_bad") / F.greatest(F.col("labelled"), F.lit(1)) - share) > how.z * spread + 1e-12
    placed = salted_join(salted, shapes, ["host", "shape"], how.salts).withColumn(
        "branch", F.when((F.col("labelled") > 0) & differs, F.col("template")).otherwise(F.col("shape"))
    )
    branches = placed.groupBy("host", "branch").agg(
        F.sum("labelled").alias("b_labelled"), F.sum("n_bad").alias("b_bad")
    )
    purity = (F.col("b_labelled") - F.col("b_bad") + how.prior * F.col("prior_share")) / (
        F.col("b_labelled") + how.prior
    )
    branches = branches.withColumn("prior_share", F.coalesce(total.scalar(), F.lit(0.5)))
    branches = branches.withColumn("purity", purity).withColumn("rejected", F.col("purity") < how.threshold)
    return salted_join(
        placed.select("host", "template", "branch", "_salt"),
        branches.select("host", "branch", "purity", "rejected"),
        ["host", "branch"],
        how.salts,
    ).drop("_salt")


def filter_urls(pages: DataFrame, rules=RULES, how: Templates | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for every row of `pages`.

    `pages` needs page_id, url and a boolean `bad`, null where a page has no label. A null or
    malformed url has an empty host and path. Pages under a rule still count in the templates.
    Repeated rows stay, each for itself; a table without labels rejects nothing.
    """
    how = how or Templates()
    rows = pages.select(
        "page_id",
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
        F.col("bad").cast("boolean").alias("bad"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(how.salts)).cast("int").alias("_salt"),
    )
    rows = add_templates(rows, how)
    known = judge_templates(rows, how)
    ruled = matching_rule(F.col("host"), F.col("path"), rules)
    return (
        salted_join(rows, known, ["host", "template"], how.salts)
        .withColumn("_ruled", ruled)
        .select(
            "page_id",
            "host",
            "path",
            F.col("_ruled.rule").alias("rule"),
            F.coalesce("_ruled.verdict", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
            "template",
            "purity",
        )
    )


def labelled_pages(spark, sf_dir: str) -> DataFrame:
    """Pages with the label of the document that the last number of their path names."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = (
        spark.read.parquet(f"{sf_dir}/labels.parquet")
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    )
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})[^/\d]*/?$", 1)
    return pages.withColumn("_doc", number.try_cast("bigint")).join(
        labels, "_doc", "left"
    )


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(labelled_pages(spark, sf_dir))
