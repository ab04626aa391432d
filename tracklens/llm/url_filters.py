"""URL filters with a path-template tree per host.

Paths are cut into segments; runs of digits are lexical variables. Level by level below each host, a segment becomes a
wildcard when it has siblings and its labelled purity does not differ from that of its parent's labelled rows (a test against the
pooled siblings, so no pairs are compared). A branch without labels does not differ; however small its share is, one whose labels differ stays. Templates whose smoothed purity falls below a threshold are rejected.
Fixed rules by host suffix and path prefix come first; the longest fitting rule decides.

The tree is grown on distinct shapes with their counts, never on urls, and each round is two aggregations with joins back.

Nulls: a null url or one without "://" has empty host and path and falls into the empty host's root template. Repeated
rows give one row each. Labels without a url, or with a null label, count for nothing. Paths are grown to their last segment, however
many there are: a stretch that all open paths of a branch share is taken in one step, so a round is spent for each true
branching on a path, not for each segment.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracklens.llm.common import field_of, join_on_group, lowered, packed, scalar, table
from tracklens.session import stage_table

# Host suffix, path prefix and verdict of each rule.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SIMILAR_Z = 2.58
PRIOR_ROWS = 4.0
LEAST_PURITY = 0.5
WILDCARD = "*"


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule with its verdict; null if none fits. Of equally long rules the one with the longer host wins."""
    ordered = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), reverse=True)
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for suffix, prefix, verdict in reversed(ordered):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        chosen = F.when(fits, F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def shape_of(path: Column) -> Column:
    """Path segments with digit runs as variables."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != "")


def _shared(low: Column, high: Column) -> Column:
    """How many leading entries two arrays have in common."""
    ends = F.least(F.size(low), F.size(high))
    return F.aggregate(F.sequence(F.lit(0), ends), F.lit(0), lambda n, i: F.when((n == i) & (i < ends) & (F.get(low, i) == F.get(high, i)), n + 1).otherwise(n))


def _purity(good: Column, labelled: Column, prior: Column) -> Column:
    return (good + F.lit(PRIOR_ROWS) * prior) / (labelled + F.lit(PRIOR_ROWS))


def templates(shapes: DataFrame, total: int) -> DataFrame:
    """Template and smoothed purity of each shape: staged rows shape_key_, host_, parts_, n_, good_, labelled_."""
    open_ = stage_table(shapes.withColumn("template_", F.array().cast("array<string>")), "level")
    finished = []
    while True:
        ended = F.size("parts_") <= F.size("template_")
        finished.append(open_.filter(ended))
        rest = open_.filter(~ended)
        total_open = rest.count()
        if total_open == 0:
            break
        rest = rest.withColumn("tail_", F.slice("parts_", F.size("template_") + 1, F.size("parts_"))).withColumn("node_", F.xxhash64("host_", "template_"))
        # The least and the greatest remainder of a node share what all of its remainders share.
        nodes = rest.groupBy("node_").agg(F.count(F.lit(1)).alias("shapes_"), F.min("tail_").alias("low_"), F.max("tail_").alias("high_"))
        nodes = stage_table(nodes.select("node_", "shapes_", _shared(F.col("low_"), F.col("high_")).alias("shared_")), "nodes")
        moved = join_on_group(rest, nodes, "node_", "shapes_", ["shared_"], total_open, ["shape_key_"])
        moved = moved.select(*shapes.columns, F.concat("template_", F.slice("tail_", F.lit(1), F.col("shared_"))).alias("template_"))
        step = stage_table(moved.withColumn("part_", F.get("parts_", F.size("template_"))).withColumn("node_", F.xxhash64("host_", "template_")), "step")
        branch = step.filter("part_ IS NOT NULL").groupBy("node_", "part_").agg(F.sum("good_").alias("good_"), F.sum("labelled_").alias("labelled_"), F.count(F.lit(1)).alias("shapes_"))
        branch = stage_table(branch, "branches")
        parent = branch.groupBy("node_").agg(
            F.sum("good_").alias("all_good_"), F.sum("labelled_").alias("all_labelled_"), F.count(F.lit(1)).alias("siblings_"),
        )
        parent = stage_table(parent, "parents")
        facts = ["all_good_", "all_labelled_", "siblings_"]
        both = join_on_group(branch, parent, "node_", "siblings_", facts, branch.count(), ["part_"])
        pooled = (F.col("all_good_") + 1) / (F.col("all_labelled_") + 2)
        own = F.col("good_") / F.when(F.col("labelled_") > 0, F.col("labelled_"))
        error = F.sqrt(pooled * (1 - pooled) / F.when(F.col("labelled_") > 0, F.col("labelled_")))
        similar = (F.col("siblings_") > 1) & F.coalesce(F.abs(own - pooled) <= F.lit(SIMILAR_Z) * error, F.lit(True))
        named = both.select(F.xxhash64("node_", "part_").alias("branch_"), "shapes_", F.when(similar, F.lit(WILDCARD)).otherwise(F.col("part_")).alias("name_"))
        keyed = step.withColumn("branch_", F.when(F.col("part_").isNotNull(), F.xxhash64("node_", "part_")))
        grown = join_on_group(keyed, stage_table(named, "named"), "branch_", "shapes_", ["name_"], total_open, ["shape_key_"]).withColumn(
            "template_", F.when(F.col("name_").isNull(), F.col("template_")).otherwise(F.concat("template_", F.array("name_")))
        )
        open_ = stage_table(grown.select(*open_.columns), "level")
    grown = stage_table(reduce(DataFrame.unionByName, finished).withColumn("node_", F.xxhash64("host_", "template_")), "grown")
    whole = scalar(grown.agg(F.sum("good_"), F.sum("labelled_")))
    prior = ((whole[0] or 0) + 1.0) / ((whole[1] or 0) + 2.0)
    sums = [F.sum("good_").alias("g_"), F.sum("labelled_").alias("l_"), F.count(F.lit(1)).alias("shapes_")]
    by_host = stage_table(grown.groupBy("host_").agg(*sums).select("host_", "shapes_", _purity(F.col("g_"), F.col("l_"), F.lit(prior)).alias("host_purity_")), "hosts")
    by_template = grown.groupBy("node_", "host_").agg(*sums)
    pure = join_on_group(by_template, by_host, "host_", "shapes_", ["host_purity_"], grown.count(), ["node_"])
    pure = stage_table(pure.select("node_", "shapes_", _purity(F.col("g_"), F.col("l_"), F.col("host_purity_")).alias("purity_")), "pure")
    return join_on_group(grown, pure, "node_", "shapes_", ["purity_"], grown.count(), ["shape_key_"]).select(
        "shape_key_", "n_", F.concat(F.lit("/"), F.array_join("template_", "/")).alias("template_"), "purity_"
    )


def judge_urls(pages: DataFrame, labelled: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity. `labelled` has url and good (0 or 1)."""
    def shaped(df: DataFrame, column: str, *more: Column) -> DataFrame:
        address = field_of(column)
        split = packed(df).select(*more, host_of(address).alias("host_"), path_of(address).alias("path_"))
        parts = split.withColumn("parts_", shape_of(F.col("path_")))
        return parts.withColumn("shape_key_", F.sha2(F.concat(F.col("host_"), F.lit("\n"), F.array_join("parts_", "/")), 256))

    rows = stage_table(shaped(pages, url, field_of(page_id).alias("id_")), "pages")
    good = F.expr("row_.good = 1").alias("is_good_")
    marks = shaped(labelled, "url", good).filter("is_good_ IS NOT NULL")
    counted = rows.select("shape_key_", "host_", "parts_", F.lit(1).cast("long").alias("n_"), F.lit(0).cast("long").alias("good_"), F.lit(0).cast("long").alias("labelled_"))
    counted = counted.unionByName(marks.select("shape_key_", "host_", "parts_", F.lit(0).cast("long").alias("n_"), F.col("is_good_").cast("long").alias("good_"), F.lit(1).cast("long").alias("labelled_")))
    shapes = counted.groupBy("shape_key_").agg(F.first("host_").alias("host_"), F.first("parts_").alias("parts_"), F.sum("n_").alias("n_"), F.sum("good_").alias("good_"), F.sum("labelled_").alias("labelled_"))
    total = rows.count()
    known = stage_table(templates(stage_table(shapes, "shapes"), total), "templates")
    joined = join_on_group(rows, known, "shape_key_", "n_", ["template_", "purity_"], total, ["id_"])
    rule = rule_of(F.col("host_"), F.col("path_"), rules)
    verdict = F.coalesce(rule["verdict"], F.when(F.col("purity_") < LEAST_PURITY, F.lit("block")).otherwise(F.lit("allow")))
    return joined.select(
        F.col("id_").alias("page_id"), F.col("host_").alias("host"), F.col("path_").alias("path"), rule["rule"].alias("rule"), verdict.alias("verdict"),
        F.col("template_").alias("template"), F.col("purity_").alias("purity"),
    )


def op2_url_filters(spark, sf_dir) -> DataFrame:
    """The last number of a page's path names the document it shows; that document's quality label is the page's."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    numbered = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '(?s)^[^?#]*[^0-9?#]([0-9]+)[^0-9?#]*', 1) AS BIGINT)").alias("shown"))
    labelled = numbered.join(labels, F.col("shown") == F.col("doc_id")).select("url", F.col("quality").alias("good"))
    return judge_urls(pages, labelled)
