"""URL filters by a path-template tree per host.

Paths become shapes: segments that are numbers, hexadecimal ids or mix letters and
digits turn into wildcards.  Shapes are counted per host (with labelled and bad
pages) before anything is joined, so a hot host costs a row per shape.  The tree
is then refined level by level: sibling branches whose bad shares do not differ
statistically merge into one ``*`` branch.  A template is rejected if its smoothed
share of bad labels is high.  Rules go before templates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.llm.shared import shared_dir, stored

# fixed values of the contract: verdict, rule (host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEPTH = 4  # segments of a shortened shape; the tree has as many levels as the longest shape
LEAST_LABELLED = 8  # a branch with fewer labelled pages merges with its siblings
Z = 1.96  # difference of two shares, in standard errors, from which siblings stay apart
WEIGHT = 4.0  # pseudo-counts at the overall bad share
REJECT = 0.5  # smoothed bad share from which a template is rejected
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url):
    """(host, path) of a url; both empty if it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(rules, what: str):
    """The longest fitting rule (or its verdict); null if none fits."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{rest}")
        out = F.when(fits, F.lit(verdict if what == "verdict" else rule)).otherwise(out)
    return out


def shape(path, depth: int | None = DEPTH):
    """Path segments with variable ones generalised; at most ``depth``, the rest as ``**`` (None: all)."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(s):
        stem, ending = F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        kind = (F.when(stem.rlike(r"^[0-9]+$"), "{n}").when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), "{h}")
                .when(stem.rlike("[0-9]") & stem.rlike("[^0-9]") | (F.length(stem) > 24), "{v}").otherwise(stem))
        return F.concat(kind, ending)

    g = F.transform(segments, general)
    return g if depth is None else F.when(F.size(g) > depth, F.concat(F.slice(g, 1, depth), F.array(F.lit("**")))).otherwise(g)


def templates(shapes: DataFrame, bad_share: float) -> DataFrame:
    """``shapes`` (host, shape, n, m labelled, b bad) with template and purity (smoothed bad share).

    Level by level: a branch keeps its segment only if it holds LEAST_LABELLED labelled
    pages and its bad share differs from its siblings' by Z standard errors; all others become ``*``.

    A branch can split only while it has more labelled pages than that, good and bad ones.  One that cannot
    is finished at once, as all its paths go on together: a segment stays where all of them have the same.  So
    there are as many rounds as levels with enough labels, however long a single path is.
    """
    folder = shared_dir(shapes.sparkSession)
    # at: the level from which the rest of the template follows at once; null while the branch may split
    t = shapes.withColumn("template", F.lit("")).withColumn("at", F.lit(None).cast("int"))
    group = ["host", "template"]
    level = 0
    while True:
        # a level reads the last one several times: written, so plans do not multiply
        t = stored(t, f"{folder}/{level}").withColumn("seg", F.when(F.col("at").isNull(), F.get("shape", F.lit(level))))
        own = t.where("seg is not null").groupBy(*group, "seg").agg(F.sum("m").alias("m"), F.sum("b").alias("b"))
        every = own.groupBy(*group).agg(F.sum("m").alias("all_m"), F.sum("b").alias("all_b"), F.count("*").alias("kinds"))
        every = stored(every.where((F.col("all_m") > LEAST_LABELLED) & (F.col("all_b") > 0) & (F.col("all_b") < F.col("all_m"))), f"{folder}/{level}-open")
        if not every.limit(1).count():
            break
        j = own.join(every, group)
        rest_m, rest_b = F.col("all_m") - F.col("m"), F.col("all_b") - F.col("b")
        p = (F.col("all_b") + 0.5) / (F.col("all_m") + 1.0)
        gap = F.abs(F.try_divide("b", "m") - F.try_divide(rest_b, rest_m))
        error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), "m") + F.try_divide(F.lit(1.0), rest_m)))
        apart = (F.col("m") >= LEAST_LABELLED) & F.coalesce(gap >= Z * error, F.lit(False))
        kept = j.select(*group, "seg", F.when((F.col("kinds") == 1) | apart, F.col("seg")).otherwise(F.lit("*")).alias("to"))
        t = t.join(kept, [*group, "seg"], "left")
        # a row that does not go on, or whose branch is closed, is finished from here
        t = t.withColumn("at", F.when(F.col("at").isNull() & F.col("to").isNull(), level).otherwise(F.col("at"))).withColumn(
            "template", F.when(F.col("to").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "to"))).drop("seg", "to")
        level += 1
    t = t.drop("seg").withColumn("at", F.coalesce("at", F.lit(level)))
    ahead = t.where(F.size("shape") > F.col("at")).select(*group, "at", F.posexplode(F.slice("shape", F.col("at") + 1, F.size("shape"))).alias("pos", "seg"))
    ahead = ahead.groupBy(*group, "at", "pos").agg(F.when(F.min("seg") == F.max("seg"), F.min("seg")).otherwise("*").alias("to"))
    ahead = ahead.groupBy(*group, "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda x: F.concat(F.lit("/"), x["to"])).alias("tail"))
    t = t.join(ahead, [*group, "at"], "left")
    tail = F.array_join(F.slice("tail", 1, F.greatest(F.size("shape") - F.col("at"), F.lit(0))), "")
    t = stored(t.withColumn("template", F.concat("template", F.coalesce(tail, F.lit("")))).drop("at", "tail"), f"{folder}/all")
    total = t.groupBy(*group).agg(F.sum("m").alias("tm"), F.sum("b").alias("tb"))
    return t.join(total, group).withColumn(
        "purity", (F.col("tb") + F.lit(WEIGHT * bad_share)) / (F.col("tm") + F.lit(WEIGHT))).drop("tm", "tb")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of ``pages``.

    ``labels`` has (page_id, bad): rows with nulls are skipped, of labels that repeat for
    a page any bad one counts.  A url that is null or has no ``://`` has an empty host and path and is
    judged by that host's template like any other.  Without labels nothing is rejected.
    """
    host, path = parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("shape", shape(F.col("path"), None))
    y = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    # only labelled pages meet the labels in a join; counts combine before the shuffle
    marks = p.select("page_id", "host", "shape").join(y, "page_id").groupBy("host", "shape").agg(F.count("*").alias("m"), F.sum("bad").alias("b"))
    shapes = p.groupBy("host", "shape").agg(F.count("*").alias("n")).join(marks, ["host", "shape"], "left").na.fill(0, ["m", "b"])
    whole = marks.agg(F.sum("b").alias("b"), F.sum("m").alias("m")).first()
    share = (whole.b or 0) / whole.m if whole.m else 0.0
    t = templates(shapes, share).select("host", "shape", "template", F.col("purity").cast("double").alias("purity"))
    return p.join(t, ["host", "shape"]).select(
        "page_id", "host", "path", ruled(rules, "rule").alias("rule"),
        F.coalesce(ruled(rules, "verdict"), F.when((F.col("purity") >= reject) & F.lit(share > 0), "block").otherwise("allow")).alias("verdict"),
        "template", "purity")


def page_labels(labels: DataFrame) -> DataFrame:
    """(page_id, bad) from the label table: a page counts as bad if the label of its number has low quality or toxicity."""
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))])
    return labels.where("quality is not null or toxic is not null").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
