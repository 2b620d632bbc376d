"""URL filter by a tree of path templates, with DataFrame operations only.

Urls under a rule are the labelled ones: the rule's verdict is the label. For each host the
paths form a tree of segments. Segments that look like identifiers (with a digit, or very
long) become ``*`` at once. Level by level from the root, every labelled child of a node is
tested, and becomes ``*`` too unless its share of blocked labels differs from that of the
node's other children by a two-proportion z test; children without labels become ``*``. A
template is rejected when its smoothed purity

    (blocked + strength * prior) / (labelled + strength)

reaches the threshold. Segments below ``depth`` are folded into one ``**``. Rules are a list
in the program, compiled into one expression; url counts pass only as sums per template, so
one host or template may hold any part of the rows.

Defined results: null urls and urls without ``://`` have an empty host and path, fit no rule
and are judged as one template of the empty host; repeated page ids are judged row by row;
an empty table gives no rows. No other column than page_id and url is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabbridge.llm.staging import Scratch, result, scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # "block" or "allow"
    text: str  # host, then the start of the path, like "example.net/en/"


RULES = (
    Rule("block", "net/"),
    Rule("allow", "example.net/en/"),
    Rule("block", "example.com/de/"),
    Rule("allow", "org/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The text of the longest rule that fits, or null."""
    fits = []
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        domain, _, start = rule.text.partition("/")
        here = (host == domain) | host.endswith("." + domain)
        fits.append(F.when(here & path.startswith("/" + start), F.lit(rule.text)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def verdict_of(rule: Column, rules: Sequence[Rule] = RULES) -> Column:
    return F.coalesce(*[F.when(rule == r.text, F.lit(r.verdict)) for r in rules], F.lit(None).cast("string"))


def segments(path: Column, depth: int, longest: int) -> Column:
    """The first ``depth`` segments, identifiers as ``*``, deeper ones as one ``**``.

    A last segment loses its file ending; a closing ``/`` makes no segment.
    """
    plain = F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"\.[A-Za-z]{1,5}$", "")
    parts = F.split(plain, "/+", depth + 1)
    code = lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > longest), F.lit("*")).otherwise(s)
    head = F.transform(F.slice(parts, 1, depth), code)
    return F.when(F.size(parts) > depth, F.concat(head, F.array(F.lit("**")))).otherwise(head)


def templates(leaves: DataFrame, depth: int, z_limit: float, tables: Scratch) -> DataFrame:
    """``leaves`` (host, segs, n_block, n_labelled) with ``template``, the merged path.

    ``template`` holds the levels done so far and names the node. Each level is staged. So are
    a node's totals: they meet its children in a join of plain shuffles, which AQE can split
    where one node has very many children.
    """
    tree = leaves.withColumn("template", F.array().cast("array<string>"))
    last = None
    for level in range(1, depth + 2):
        child = F.try_element_at("segs", F.lit(level))
        inner = tree.where(F.size("segs") >= level)
        sums = [F.sum("n_block").alias("b"), F.sum("n_labelled").alias("m")]
        labelled = inner.where(F.col("n_labelled") > 0)
        children = labelled.groupBy("host", "template", child.alias("child")).agg(*sums)
        whole = tables.put(
            labelled.groupBy("host", "template").agg(F.sum("n_block").alias("all_b"), F.sum("n_labelled").alias("all_m"))
        )
        rest_b, rest_m = F.col("all_b") - F.col("b"), F.col("all_m") - F.col("m")
        pooled = F.col("all_b") / F.col("all_m")
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("m") + 1 / rest_m))
        z = F.abs(F.col("b") / F.col("m") - rest_b / rest_m) / spread
        # unlabelled branches hold no evidence against each other; a labelled one that
        # differs from its siblings, or has none with labels, keeps its name
        differs = F.when(rest_m == 0, F.lit(True)).when(spread == 0, F.lit(False)).otherwise(z > z_limit)
        kept = children.join(whole, ["host", "template"]).where(differs).select(
            F.col("host").alias("h"), F.col("template").alias("t"), F.col("child").alias("c")
        )
        name = F.when(F.size("segs") < level, F.col("template")).otherwise(
            F.concat("template", F.array(F.coalesce("c", F.lit("*"))))
        )
        named = tree.join(kept, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (child == F.col("c")), "left")
        tree = tables.put(named.withColumn("template", name).drop("h", "t", "c"))
        tables.drop(whole)
        if last is not None:
            tables.drop(last)
        last = tree
    return tree


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    *,
    depth: int = 4,
    longest: int = 24,
    z_limit: float = 2.58,
    strength: float = 4.0,
    prior: float = 0.2,
    threshold: float = 0.6,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    with scratch(pages.sparkSession, "urls") as tables:
        rows = tables.put(
            pages.select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
            .withColumn("segs", segments(F.col("path"), depth, longest))
            .withColumn("leaf", F.xxhash64("host", "segs"))
        )
        by_rule = verdict_of(F.col("rule"), rules)
        leaves = tables.put(
            rows.groupBy("host", "segs", "leaf").agg(
                F.count_if(by_rule == "block").alias("n_block"),
                F.count(F.col("rule")).alias("n_labelled"),
            )
        )
        tree = templates(leaves, depth, z_limit, tables)
        tables.drop(leaves)
        of_template = tree.groupBy("host", "template").agg(
            F.sum("n_block").alias("b"), F.sum("n_labelled").alias("m")
        )
        purity = (F.col("b") + F.lit(strength * prior)) / (F.col("m") + F.lit(strength))
        judged = tree.join(of_template, ["host", "template"]).select(
            "leaf", F.col("host").alias("leaf_host"), F.col("segs").alias("leaf_segs"),
            F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), purity.alias("purity"),
        )
        same = reduce(
            lambda a, b: a & b,
            [rows["leaf"] == judged["leaf"], rows["host"] == judged["leaf_host"], rows["segs"] == judged["leaf_segs"]],
        )
        method = F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
        return result(
            rows.join(judged, same).select(
                "page_id", "host", "path", "rule",
                F.coalesce(by_rule, method).alias("verdict"), "template", "purity",
            ),
            "urls",
        )
