"""URL rules and a path-template tree whose templates are judged by the labels of their pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: (action, host, path). A rule fits its host and all subdomains.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Two shares differ beyond this many standard errors.
Z = 1.96
#: The prior: so many good and bad pages stand above each host's root; a template whose smoothed purity is below PURITY is rejected.
GOOD, BAD, PURITY = 4, 1, 0.5
def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its action."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def shape(segment: Column) -> Column:
    """What a variable segment keeps: words of letters, also several with a dash, underscore, plus or blank between, become 0, which no skeleton holds."""
    return F.regexp_replace(segment, r"\p{L}+(?:[-_+ ]\p{L}+)*", "0")


def skeleton(path: Column) -> Column:
    """The segments of a path; runs of digits, long hexadecimal and long mixed segments are wildcards.

    One to three segments that come three times or more in a row, as in a
    crawler's trap, stand once, and 0+ behind them.
    """

    def general(s: Column) -> Column:
        s = F.when(s.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$|^.{40,}$"), "*").otherwise(s)
        return F.regexp_replace(s, "[0-9]+", "*")

    parts = F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), general)
    once = F.regexp_replace(F.concat(F.array_join(parts, "/"), F.lit("/")), r"(?s)(?<![^/])(?<one>(?:[^/]+/){1,3}?)\k<one>{2,}", "${one}0+/")
    return F.filter(F.split(once, "/", -1), lambda s: s != "")


def smoothed(good: Column, labelled: Column, above: Column) -> Column:
    """Share of good pages, drawn toward the share above as if GOOD + BAD pages had that share."""
    return (good + (GOOD + BAD) * above) / (labelled + (GOOD + BAD))


def differ(x: Column, n: Column, y: Column, m: Column) -> Column:
    """Whether x of n and y of m differ significantly, by a test of two shares."""
    pooled = (x + y) / (n + m)
    return F.abs(x / n - y / m) > Z * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))


RUN = "struct<low:struct<share:double,n:bigint,b:bigint>,high:struct<share:double,n:bigint,b:bigint>,n:bigint,b:bigint,parts:bigint>"


def _runs(pairs: Column) -> Column:
    """From an ordered array of (key, parts): runs of neighbours whose shares don't differ significantly, with their lowest and highest key."""

    def run(low: Column, high: Column, n: Column, b: Column, parts: Column) -> Column:
        return F.array(F.struct(low.alias("low"), high.alias("high"), n.alias("n"), b.alias("b"), parts.alias("parts")))

    def add(runs: Column, x: Column) -> Column:
        last, key = F.element_at(runs, -1), x["key"]
        n, b = key["n"] * x["parts"], key["b"] * x["parts"]
        one = run(key, key, n, b, x["parts"])
        both = run(last["low"], key, last["n"] + n, last["b"] + b, last["parts"] + x["parts"])
        apart = (F.size(runs) == 0) | differ(last["b"], last["n"], b, n)
        return F.when(apart, F.concat(runs, one)).otherwise(F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), both))

    return F.aggregate(pairs, F.array().cast(f"array<{RUN}>"), add)


def templates(nodes: DataFrame) -> DataFrame:
    """(host, skel, labelled, bad, template, above) of each (host, skel) of ``nodes``, which also has the counts pages, labelled and bad.

    Level by level from each host's root, the children of a node are
    generalised in three steps.

    1. A segment that one page alone holds names that page: it is variable and
       becomes its shape, so such siblings of one shape are one child.
    2. Labelled children are ordered by their smoothed share of bad pages and
       merged into branches: neighbours in this order stay together while their
       shares don't differ significantly (a test of two shares). Children with
       the same counts are one entry of this list, so it grows with the
       different pairs of counts, not with the children. A branch of one child
       keeps its name; one of several is * and its number.
    3. A child without labels joins the labelled branch that has most pages of
       the child's commonest kind of next segment (its shape), if neither the
       share of this kind nor that of labelled pages differs significantly.
       Otherwise it is a template of its own, with ? for all below it.

    above is the share of good pages that a template inherits: from the prior
    down, each node on its way draws it toward its own share, with the weight
    of its labelled pages times their share of all its pages. So a host mostly
    labelled bad condemns its unlabelled branches, and a few labels don't.

    Rounds end with the longest skeleton. A skeleton alone under its template
    is settled at once, so rounds are only as many as levels shared, and
    repeated segments are one level (``skeleton``).
    """
    node = ["host", "template"]
    nodes = nodes.select("host", "skel", "pages", "labelled", "bad", F.lit("").alias("template"), F.lit(GOOD / (GOOD + BAD)).alias("above"), (F.size("skel") == 0).alias("_done"))
    settled, level = [], 0
    while True:
        settled.append(nodes.filter("_done").drop("_done", "pages"))
        rows = nodes.filter("not _done").drop("_done")
        if rows.isEmpty():
            break
        level += 1
        rows = rows.withColumn("part", F.element_at("skel", F.lit(level)))
        kind = shape(F.coalesce(F.get("skel", F.lit(level)), F.lit("")))
        held = rows.groupBy(*node, "part").agg(F.sum("pages").alias("held"))
        child = F.when(F.col("held") == 1, shape(F.col("part"))).otherwise(F.col("part"))
        rows = checkpointed(rows.join(held, [*node, "part"]).select("*", child.alias("child"), kind.alias("kind")))
        kinds = rows.groupBy(*node, "child", "kind").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"), F.sum("pages").alias("p"), F.count("*").alias("skels"))
        sums = [F.sum(c).alias(c) for c in ("n", "b", "p", "skels")]
        children = kinds.groupBy(*node, "child").agg(*sums, F.max(F.struct("p", "kind")).alias("most"))
        parents = children.groupBy(*node).agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.sum("p").alias("all_p"))
        share = (F.col("b") + (GOOD + BAD) * F.try_divide("all_b", "all_n")) / (F.col("n") + (GOOD + BAD))
        children = checkpointed(children.join(parents, node).withColumn("key", F.when(F.col("n") > 0, F.struct(share.alias("share"), "n", "b"))))
        pairs = children.filter("n > 0").groupBy(*node, "key").agg(F.count("*").alias("parts"))
        runs = pairs.groupBy(*node).agg(_runs(F.array_sort(F.collect_list(F.struct("key", "parts")))).alias("runs"))
        numbered = F.transform("runs", lambda r, i: F.struct(r["low"].alias("low"), r["high"].alias("high"), r["parts"].alias("parts"), (i + 1).alias("i")))
        own = F.get(F.filter(numbered, lambda r: (r["low"] <= F.col("key")) & (F.col("key") <= r["high"])), F.lit(0))
        branch = F.when(own["parts"] > 1, F.concat(F.lit("*"), own["i"].cast("string"))).otherwise(F.col("child"))
        named = children.filter("n > 0").join(runs, node).select(*children.columns, branch.alias("name"))
        # the labelled branch with most pages of a kind, for each node and kind
        of_kind = kinds.join(named.select(*node, "child", "name"), [*node, "child"]).groupBy(*node, "name", "kind").agg(F.sum("p").alias("x"))
        whole = named.groupBy(*node, "name").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        near = of_kind.join(whole, [*node, "name"]).groupBy(*node, "kind").agg(F.max(F.struct("x", "name", "n", "p")).alias("near"))
        bare = children.filter("n = 0").withColumn("kind", F.col("most.kind")).join(near, [*node, "kind"], "left")
        like = ~differ(F.col("most.p"), F.col("p"), F.col("near.x"), F.col("near.p")) & ~differ(F.lit(0), F.col("p"), F.col("near.n"), F.col("near.p"))
        bare = bare.withColumn("like", F.coalesce(like, F.lit(False)))
        named = named.withColumn("like", F.lit(True)).unionByName(bare.select(*children.columns, F.when(F.col("like"), F.col("near.name")).otherwise(F.col("child")).alias("name"), "like"))
        named = checkpointed(named.drop("key", "most"))
        single = named.groupBy(*node, "name").agg((F.sum("skels") == 1).alias("alone"))
        weight = F.col("all_n") / F.col("all_p")
        named = named.join(single, [*node, "name"]).select(*node, "child", "name", "alone", "like", weight.alias("_w"), ((F.col("all_n") - F.col("all_b")) * weight).alias("_good"), (F.col("all_n") * weight).alias("_n"))
        rest = F.slice("skel", F.lit(level + 1), F.size("skel"))
        rest = F.when(F.col("pages") == 1, F.transform(rest, shape)).otherwise(rest)
        below = F.when(F.col("alone"), rest).when(~F.col("like") & (F.size("skel") > level), F.array(F.lit("?")))
        nodes = checkpointed(rows.join(named, [*node, "child"]).select(
            "host", "skel", "pages", "labelled", "bad", F.concat_ws("/", "template", "name", below).alias("template"),
            smoothed(F.col("_good"), F.col("_n"), F.col("above")).alias("above"), (F.col("alone") | ~F.col("like") | (F.size("skel") == level)).alias("_done"),
        ))
    return reduce(DataFrame.unionByName, settled)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", label: Column | None = None, most_broadcast: int = 50_000) -> DataFrame:
    """(row, host, path, rule, template, purity, verdict) for each row of ``pages``, which is row as a struct, so no names clash.

    ``label`` is true for bad pages, false for good ones and null for others;
    without it, what a rule blocks is bad and what a rule allows is good. A
    rule's action is final. Elsewhere the template decides: block where its
    labelled pages' share of good ones, smoothed by what it inherits from the
    nodes above, is under PURITY. Null urls and those without a scheme have
    empty host and path and are judged like others, and very long ones are
    judged whole. Each repeated row counts; no rows give no rows. Pages are
    summed to (host, skeleton) before the tree is built, so a hot host is only
    hot in that sum, which is made in the map tasks first.
    """
    rows = pages.select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), *([label.alias("label")] if label is not None else []))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), action.alias("action"), skeleton(F.col("path")).alias("skel"))
    bad = F.col("label") if label is not None else F.col("action") == "block"
    nodes = rows.groupBy("host", "skel").agg(F.count("*").alias("pages"), F.count(bad).alias("labelled"), F.count_if(bad).alias("bad"))
    tree = templates(checkpointed(nodes))
    sums = tree.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    purity = smoothed(F.col("n") - F.col("b"), F.col("n"), F.col("above")).alias("purity")
    judged = checkpointed(tree.join(sums, ["host", "template"]).select("host", "skel", "template", purity))
    judged = F.broadcast(judged) if judged.count() <= most_broadcast else judged
    verdict = F.coalesce("action", F.when(F.col("purity") < PURITY, "block").otherwise("allow"))
    return rows.join(judged, ["host", "skel"], "left").select("row", "host", "path", "rule", "template", "purity", verdict.alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "template")
