"""URL filters: rules by host and path, and path templates for what no rule fits.

Per host, paths form a tree of segments. Segments that vary become wildcards, branches that behave
like their siblings are merged into one, and a template is rejected by the smoothed share of labelled
blocks among its urls. A template without labels borrows from the same template on all hosts, that
from all urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (allow or block, host and path): fits the host and its subdomains where the path starts with the rule's; the longest wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A branch needs so many urls to keep its own name, and so many labels to be held against its siblings.
BRANCH_URLS = 5
#: Standard errors by which a branch's label share must differ from its siblings' to stay apart.
APART = 2.0
#: Weight, in labelled urls, of what a template borrows.
PRIOR = 4.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Null, or no ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), common.UPPER, common.UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equal lengths the first given wins, so it is asked last."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """A segment with what varies by nature taken out: runs of digits, and long runs of hexadecimal digits that hold one."""
    hexes = F.regexp_replace(segment, r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "{x}")
    return F.regexp_replace(hexes, r"[0-9]+", "{n}")


def templates(urls: DataFrame) -> DataFrame:
    """host, path, verdict -> with ``template``: the host's tree, one level of segments at a time, down to the last segment.

    Only (host, node, segment) counts are shuffled, summed within tasks first. A path alone at its node
    has no siblings to be merged with, so the rest of it is taken as it is: there are as many rounds as
    segments down to where the last two paths part, or one of them ends.
    """
    # The tree grows over distinct paths by shape, not over urls: thousands of numbered pages are one row.
    shaped = urls.withColumn("segs", F.transform(F.split(F.regexp_replace("path", r"^/", ""), "/"), shape)).withColumn("key", F.array_join("segs", "/"))
    tree = shaped.groupBy("host", "key").agg(F.first("segs").alias("segs"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict").isNotNull()).alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    tree = tree.select("host", "key", "segs", "n", "labelled", "blocked", F.lit("").alias("node"), F.lit(0).alias("at"))
    ended, levels = F.col("at") == F.size("segs"), []
    while True:
        levels.append(common.scratch(urls.sparkSession, "urls-tree"))
        tree.write.parquet(levels[-1])
        live = urls.sparkSession.read.schema(tree.schema).parquet(levels[-1]).where(~ended)
        if not live.take(1):
            break
        live = live.withColumn("seg", F.get("segs", F.col("at")))
        branch = live.groupBy("host", "node", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")), F.count(F.lit(1)).alias("paths"))
        node = branch.groupBy("host", "node").agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked", "paths")))
        named = branch.join(node, ["host", "node"]).select("host", "node", "seg", F.when(F.col("all_paths") > 1, _name()).alias("name"))
        rest = F.array_join(F.slice("segs", F.col("at") + 1, F.size("segs")), "/")
        tree = live.join(named, ["host", "node", "seg"]).select(
            "host", "key", "segs", "n", "labelled", "blocked", F.concat("node", F.lit("/"), F.coalesce("name", rest)).alias("node"), F.when(F.col("name").isNull(), F.size("segs")).otherwise(F.col("at") + 1).alias("at"))
    tree = urls.sparkSession.read.schema(tree.schema).parquet(*levels).where(ended)
    return shaped.join(tree.select("host", "key", F.col("node").alias("template")), ["host", "key"]).drop("segs", "key")


def _name() -> Column:
    """A branch keeps its name unless it is rare (a value that varies) or, where labels tell, no different from its siblings. How large the host is does not count."""
    n, k, b = (F.col(c).cast("double") for c in ("n", "labelled", "blocked"))
    on, ok, ob = F.col("all_n") - n, F.col("all_labelled") - k, F.col("all_blocked") - b
    rare = (on > 0) & (n < BRANCH_URLS)
    pooled = (b + ob + 1) / (k + ok + 2)
    gap = F.abs((b + 0.5) / (k + 1) - (ob + 0.5) / (ok + 1)) / F.sqrt(pooled * (1 - pooled) * (1 / (k + 1) + 1 / (ok + 1)))
    alike = (k >= BRANCH_URLS) & (ok >= BRANCH_URLS) & (gap < APART)
    return F.when(F.col("seg") == "", F.col("seg")).when(rare | alike, F.lit("*")).otherwise(F.col("seg"))


def judge(urls: DataFrame, rules=RULES, labels: Column | None = None, reject: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    Labels are the verdicts of the rules, or ``labels`` (a column of ``allow``, ``block`` or null) where
    given. Purity is the smoothed share of blocks of the row's template; rows that no rule fits are
    blocked at ``reject`` or above. Null urls and urls without ``://`` have an empty host and path and
    are judged like others; repeated rows stay rows of their own. Extra columns are not read.
    """
    host, path = parts(F.col("url"))
    rows = urls.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), (labels if labels is not None else F.lit(None).cast("string")).alias("label"))
    rows = rows.select("page_id", "label", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), F.coalesce("label", verdict).alias("verdict"))
    placed = common.written(templates(rows), "urls-placed")
    count = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict").isNotNull()).alias("k"), F.count_if(F.col("verdict") == "block").alias("b")]
    own = placed.groupBy("host", "template").agg(*count)
    wide = own.groupBy("template").agg(F.sum("k").alias("wk"), F.sum("b").alias("wb"))
    total = own.agg(F.sum("k").alias("tk"), F.sum("b").alias("tb"))  # one row
    share = own.join(wide, "template").join(F.broadcast(total))
    base = (F.col("tb") + 1) / (F.col("tk") + 2)
    across = (F.col("wb") + PRIOR * base) / (F.col("wk") + PRIOR)
    share = share.select("host", "template", ((F.col("b") + PRIOR * across) / (F.col("k") + PRIOR)).alias("purity"))
    share = common.written(share, "urls-share")  # a table on either side, so that a hot host's partition can be split
    return placed.join(share, ["host", "template"]).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))


QUERIES = {"op2_url_filter": op2_url_filter}
ORACLES: dict[str, str] = {}
