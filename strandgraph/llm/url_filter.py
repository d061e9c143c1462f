"""URL filters: longest-rule verdicts, and per-host path-template trees judged by labelled purity.

Every url is cut into host and path.  A rule (host, path start, verdict) fits
its host and all subdomains if the path starts with the rule's; the longest
fitting rule wins.  Where no rule fits, the method decides:

* The first ``DEPTH`` segments of a path, variable parts replaced by their
  shape, are a way from the root of the host's tree; what lies deeper is one
  last step ``**``.  The tree is built from the root on, a level at a time.
* A node with more than ``BRANCHES`` different children has one wildcard child.
* Siblings, those with labels first, then by size, join the first group whose
  pooled children (and labels, where both have any) two-proportion tests cannot
  tell from theirs; one without labels that fits several groups with labels
  joins none.  A group is one node from then on, its members' subtrees pooled.
* A node's purity is (blocked + STRENGTH * p) / (labelled + STRENGTH), where p
  is its parent's purity without the node's own labels; above the root p is the
  share of blocked ones among all labelled urls.  So a template without labels
  takes over the evidence of its siblings and parents.  It is rejected if its
  purity is at least ``purity``.

Labels come from a column of the caller; the query uses the rules' verdicts.
``evidence`` names what decided: ``rule``, ``template`` (labels on the template
itself, or its merged siblings), ``branch`` (labels elsewhere on the host) or
``prior`` (none on the host).

Rows are folded to counted templates first.  All that is grouped afterwards is
bounded by BRANCHES, and small tables come back to large ones by ``Attach``,
which broadcasts a small side of counted size and salts the join otherwise, so
that a host with a third of all rows is no hot task.

Defined results: a null url, or one without "://", has an empty host and path,
fits no rule and is allowed; empty tables give empty results; repeated rows
give repeated results; urls of any length are cut whole; only the id and url
columns (and labels) are read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandgraph.llm.common import WorkTables, map_batches

# The rules of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEPTH, BRANCHES, STRENGTH = 4, 24, 10.0
#: Siblings of fewer urls are not merged; two shares differ beyond SIMILAR_Z standard errors.
LEAST, SIMILAR_Z = 5, 2.58
#: Tables of at most so many rows are broadcast; larger ones meet the other side on SALTS copies.
BROADCAST_ROWS, SALTS = 100_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def after_scheme(url: Column) -> Column:
    """What follows the first "://"; empty if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return text, verdict


def shape(segment: Column) -> Column:
    """Variable segments by their form, keeping a short file ending; literal ones as they are."""
    return (
        F.when(segment.rlike(r"^[0-9]+(\.[a-z]{1,5})?$"), F.regexp_replace(segment, r"^[0-9]+", "{n}"))
        .when(segment.rlike(r"^[0-9a-fA-F-]{8,}(\.[a-z]{1,5})?$"), F.regexp_replace(segment, r"^[0-9a-fA-F-]+", "{h}"))
        .when(segment.rlike(r"[0-9]"), F.regexp_replace(segment, r"[0-9]+", "{n}"))
        .otherwise(segment)
    )


def way_of(path: Column) -> Column:
    """The shaped segments of a path, at most DEPTH, with ``**`` for what lies deeper."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    near = F.transform(F.slice(segments, 1, DEPTH), shape)
    return F.when(F.size(segments) > DEPTH, F.concat(near, F.array(F.lit("**")))).otherwise(near)


class Attach:
    """Joins of large tables with small ones (one row a key) that make no hot task of a hot key.

    A small side of at most BROADCAST_ROWS rows is broadcast, a larger one
    meets the other side on SALTS copies.  ``templates`` bounds every table
    derived from so many templates; small sides are counted only beyond it.
    """

    def __init__(self, work: WorkTables, templates: int):
        self.work, self.bounded = work, templates * (DEPTH + 2) <= BROADCAST_ROWS

    def __call__(self, large: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
        if self.bounded:
            return large.join(F.broadcast(small), keys, how)
        small, _ = self.work.save(small)
        if small.count() <= BROADCAST_ROWS:
            return large.join(F.broadcast(small), keys, how)
        copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return large.withColumn("__salt", F.floor(F.rand(17) * SALTS).cast("int")).join(copies, [*keys, "__salt"], how).drop("__salt")


def differs(n1: float, k1: float, n2: float, k2: float) -> bool:
    """Whether a two-proportion test tells k1 of n1 from k2 of n2."""
    p = (k1 + k2) / (n1 + n2)
    error = (max(p * (1 - p), 1e-4) * (1 / n1 + 1 / n2)) ** 0.5
    return abs(k1 / n1 - k2 / n2) > SIMILAR_Z * error


def alike(a: dict, b: dict) -> bool:
    """Whether two nodes may be one: similar shares of every child, of paths that end there, and of labels."""
    keys = a["children"].keys() | b["children"].keys()
    if any(differs(a["n"], a["children"].get(k, 0), b["n"], b["children"].get(k, 0)) for k in keys):
        return False
    return not (a["seen"] and b["seen"]) or not differs(a["seen"], a["bad"], b["seen"], b["bad"])


def groups_of(siblings: list[dict]) -> dict[str, str]:
    """The group's name of each sibling (name, n, seen, bad, children) that changes its name."""
    groups: list[dict] = []
    for s in sorted(siblings, key=lambda s: (not s["seen"], -s["n"], s["name"])):
        homes = [g for g in groups if s["n"] >= LEAST and g["n"] >= LEAST and alike(g, s)]
        if not s["seen"] and sum(bool(g["seen"]) for g in homes) > 1:
            continue  # like groups that labels tell apart: it stays by itself, under its parent's evidence
        home = homes[0] if homes else None
        if home is None:
            groups.append({**s, "children": dict(s["children"]), "members": [s["name"]]})
            continue
        home["members"].append(s["name"])
        for k in ("n", "seen", "bad"):
            home[k] += s[k]
        for k, v in s["children"].items():
            home["children"][k] = home["children"].get(k, 0) + v
    return {m: "(" + "|".join(sorted(g["members"])) + ")" for g in groups if len(g["members"]) > 1 for m in g["members"]}


def merged_names(batches):
    """(host, parent, name, group) of siblings that merge; a row holds all of one parent's children."""
    for batch in batches:
        out = []
        for host, parent, siblings in zip(*(batch.column(c).to_pylist() for c in ("host", "parent", "siblings")), strict=True):
            found = groups_of([{**{k: s[k] for k in ("name", "n", "seen", "bad")}, "children": {c["name"]: c["n"] for c in s["children"]}} for s in siblings])
            out += [(host, parent, name, group) for name, group in found.items()]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "parent", "name", "group"])


def tree_level(ways: DataFrame, level: int, attach: Attach) -> DataFrame:
    """(host, parent, name, group): the siblings at ``level`` (from 0) that merge; ``done`` are the names above it."""
    at = ways.where(F.size("way") > level)
    name, below = F.col("way")[level], F.when(F.size("way") > level + 1, F.col("way")[level + 1]).otherwise(F.lit("$"))
    parent = F.array_join(F.slice("way", 1, level), "/")
    pairs = at.groupBy("host", parent.alias("parent"), name.alias("name"), below.alias("child")).agg(*(F.sum(c).alias(c) for c in ("n", "seen", "bad")))
    width = pairs.where("child <> '$'").groupBy("host", "parent", "name").agg((F.count("*") > BRANCHES).alias("wide")).where("wide")
    folded = attach(pairs, width, ["host", "parent", "name"]).withColumn("child", F.when(F.col("wide") & (F.col("child") != "$"), "*").otherwise(F.col("child")))
    folded = folded.groupBy("host", "parent", "name", "child").agg(*(F.sum(c).alias(c) for c in ("n", "seen", "bad")))
    nodes = folded.groupBy("host", "parent", "name").agg(*(F.sum(c).alias(c) for c in ("n", "seen", "bad")), F.collect_list(F.struct(F.col("child").alias("name"), "n")).alias("children"))
    families = nodes.groupBy("host", "parent").agg(F.collect_list(F.struct("name", "n", "seen", "bad", "children")).alias("siblings")).where(F.size("siblings") > 1)
    return map_batches(families, merged_names, "host string, parent string, name string, group string")


def renamed(ways: DataFrame, changes: DataFrame, level: int, new: Column, attach: Attach) -> DataFrame:
    """``ways`` with the name at ``level`` replaced by ``new`` where ``changes`` (host, parent, ...) has a row."""
    keyed = ways.withColumn("parent", F.array_join(F.slice("way", 1, level), "/")).withColumn("name", F.when(F.size("way") > level, F.col("way")[level]))
    keys = [c for c in changes.columns if c in ("host", "parent", "name")]
    joined = attach(keyed, changes, keys)
    way = F.transform("way", lambda s, i: F.when((i == level) & new.isNotNull(), new).otherwise(s))
    return joined.select("host", "raw", way.alias("way"), "n", "seen", "bad")


def grow_tree(leaves: DataFrame, deepest: int, attach: Attach) -> DataFrame:
    """(host, raw, way, n, seen, bad): the template ``way`` of each shaped way ``raw`` after widening and merging."""
    ways = leaves.select("host", F.col("way").alias("raw"), "way", "n", "seen", "bad")
    for level in range(deepest):
        parent = F.array_join(F.slice("way", 1, level), "/")
        children = ways.where(F.size("way") > level).groupBy("host", parent.alias("parent"), F.col("way")[level].alias("name")).agg(F.count("*").alias("ways"))
        wide = children.groupBy("host", "parent").agg((F.count("*") > BRANCHES).alias("wide")).where("wide")
        ways = renamed(ways, wide, level, F.when(F.col("wide"), F.lit("*")), attach)
        ways, _ = attach.work.save(renamed(ways, tree_level(ways, level, attach), level, F.col("group"), attach))
    return ways


def judge_templates(ways: DataFrame, purity: float, attach: Attach) -> DataFrame:
    """(host, raw, template, score, evidence, rejected) for every shaped way."""
    total = ways.agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).first()
    share = F.lit(total["bad"] / total["seen"] if total["seen"] else 0.0)
    templates = ways.groupBy("host", "way").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    nodes = (
        templates.select("host", "seen", "bad", F.explode(F.transform(F.sequence(F.lit(0), F.size("way")), lambda d: F.slice("way", F.lit(1), d))).alias("node"))
        .groupBy("host", "node")
        .agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    )
    above = templates.select("host", "way", F.explode(F.transform(F.sequence(F.lit(0), F.size("way")), lambda d: F.slice("way", F.lit(1), d))).alias("node"))
    # From the root to the template, at most DEPTH + 2 nodes.
    line = attach(above, nodes, ["host", "node"]).groupBy("host", "way").agg(F.sort_array(F.collect_list(F.struct(F.size("node").alias("depth"), "seen", "bad"))).alias("line"))
    p = F.aggregate(
        F.sequence(F.lit(1), F.size("line") - 1),
        share,
        lambda p, i: (F.col("line")[i - 1]["bad"] - F.col("line")[i]["bad"] + STRENGTH * p) / (F.col("line")[i - 1]["seen"] - F.col("line")[i]["seen"] + STRENGTH),
    )
    prior = F.when(F.size("line") > 1, p).otherwise(share)
    own = F.element_at("line", -1)
    judged = line.select(
        "host",
        "way",
        ((own["bad"] + STRENGTH * prior) / (own["seen"] + STRENGTH)).alias("score"),
        F.when(own["seen"] > 0, "template").when(F.col("line")[0]["seen"] > 0, "branch").otherwise("prior").alias("evidence"),
    )
    return attach(ways.select("host", "raw", "way"), judged, ["host", "way"], "inner").select(
        "host", "raw", F.concat(F.lit("/"), F.array_join("way", "/")).alias("template"), "score", "evidence", (F.col("score") >= purity).alias("rejected")
    )


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, purity: float = 0.8, label: Column | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, and the template, purity and evidence of the method.

    ``label`` is 1 for urls known to be bad, 0 for good, null for unknown;
    without it the rules' own verdicts are the labels.
    """
    url = F.col(url_col)
    cut = pages.select(F.col(id_col), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), *([label.cast("int").alias("given")] if label is not None else []))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    blocked = F.col("given") if label is not None else F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    ruled = cut.withColumn("rule", text).withColumn("ruled", verdict).withColumn("blocked", blocked).withColumn("raw", way_of(F.col("path")))
    work = WorkTables(pages.sparkSession, "urls")
    leaves, _ = work.save(
        ruled.where("host <> ''").groupBy("host", F.col("raw").alias("way")).agg(F.count("*").alias("n"), F.count("blocked").alias("seen"), F.coalesce(F.sum("blocked"), F.lit(0)).cast("long").alias("bad"))
    )
    size = leaves.agg(F.count("*").alias("templates"), F.coalesce(F.max(F.size("way")), F.lit(0)).alias("deepest")).first()
    attach = Attach(work, size["templates"])
    judged, _ = work.save(judge_templates(grow_tree(leaves, size["deepest"], attach), purity, attach))
    return attach(ruled, judged, ["host", "raw"]).select(
        id_col,
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow")).alias("verdict"),
        "template",
        "score",
        F.when(F.col("ruled").isNotNull(), "rule").otherwise(F.coalesce("evidence", F.lit("prior"))).alias("evidence"),
    )
