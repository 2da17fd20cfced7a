"""URL filter by a tree of path templates per host.

A path is cut into segments and its digit runs and hex names become wildcards.
Then the tree of each host is built level by level. Below a branch with many
rare children the segment is a wildcard. Children that are left are merged when
they are statistically alike: those whose share of rejected labels does not
differ from that of their labelled siblings (two-proportion test) become one
branch, and so do those without any label. A template is rejected if its
smoothed share of rejected labels reaches ``purity``; a template without labels
never is.

Rules given by hand come first: the longest rule that fits decides, and what
rules decide are the labels of the tree. All work is on distinct generalised
paths with their counts, summed before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.urls import host, path
from palimpsest.session import materialize


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    """``depth`` segments are told apart; deeper ones are one wildcard."""

    depth: int = 6
    many: int = 16
    rare: float = 4.0
    z: float = 2.0
    strength: float = 2.0
    prior: float = 0.1
    purity: float = 0.5


def rule_verdict(rules: list[Rule], host_: Column, path_: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null. Of equally
    long rules the first in order of name wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name), reverse=False):
        at_host = (host_ == rule.host) | host_.endswith("." + rule.host)
        fits = at_host & path_.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _general(segment: Column) -> Column:
    hexed = F.when(
        segment.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{h}")
    ).otherwise(segment)
    return F.regexp_replace(hexed, r"[0-9]+", "{n}")


def segments(path_: Column, settings: Settings) -> Column:
    """Generalised segments of a path; empty ones are left out."""
    parts = F.filter(F.split(path_, "/"), lambda s: s != "")
    few = F.transform(F.slice(parts, 1, settings.depth), _general)
    return F.concat(
        few, F.when(F.size(parts) > settings.depth, F.array(F.lit("{**}"))).otherwise(F.array())
    )


def templates(paths: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``host, parts, n, labelled, rejected`` to ``host, parts, template,
    purity``: the template of every distinct generalised path and its smoothed
    share of rejected labels, null without labels."""
    settings = settings or Settings()
    tree = paths.withColumn("template", F.lit(""))
    for level in range(settings.depth + 1):
        tree = tree.withColumn("part", F.get("parts", F.lit(level)))
        kids = (
            tree.filter("part is not null")
            .groupBy("host", "template", "part")
            .agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "rejected")])
        )
        siblings = kids.groupBy("host", "template").agg(
            F.count("*").alias("kids"),
            F.sum("n").alias("all_n"),
            F.sum("labelled").alias("all_labelled"),
            F.sum("rejected").alias("all_rejected"),
        )
        variable = (F.col("kids") >= settings.many) & (F.col("all_n") < settings.rare * F.col("kids"))
        rest_n = F.col("all_labelled") - F.col("labelled")
        rest = (F.col("all_rejected") - F.col("rejected") + 0.5) / (rest_n + 1)
        own = (F.col("rejected") + 0.5) / (F.col("labelled") + 1)
        pooled = (F.col("all_rejected") + 0.5) / (F.col("all_labelled") + 1)
        error = F.sqrt(pooled * (1 - pooled) * (1 / (F.col("labelled") + 1) + 1 / (rest_n + 1)))
        alike = (rest_n > 0) & (F.abs(own - rest) < settings.z * error)
        merged = (
            F.when(variable, F.lit("{*}"))
            .when(F.col("kids") == 1, F.col("part"))
            .when(F.col("labelled") == 0, F.lit("{unlabelled}"))
            .when(alike, F.lit("{alike}"))
            .otherwise(F.col("part"))
        )
        names = kids.join(siblings, ["host", "template"]).select(
            F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("part").alias("_s"),
            merged.alias("_name"),
        )
        tree = (
            tree.join(
                names,
                (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col("part") == F.col("_s")),
                "left",
            )
            .withColumn(
                "template",
                F.when(F.col("_name").isNull(), F.col("template")).otherwise(
                    F.concat("template", F.lit("/"), "_name")
                ),
            )
            .drop("_h", "_t", "_s", "_name", "part")
        )
        tree = materialize(tree, "templates")
    share = (F.sum("rejected") + settings.strength * settings.prior) / (
        F.sum("labelled") + settings.strength
    )
    judged = tree.groupBy("host", "template").agg(
        F.when(F.sum("labelled") > 0, share).alias("purity")
    )
    return tree.select("host", "parts", "template").join(judged, ["host", "template"])


def filter_urls(
    pages: DataFrame,
    rules: list[Rule],
    settings: Settings | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row.

    ``labels`` (``url, rejected`` 0 or 1) add to the labels that rules give. A
    null url, or one without ``://``, has an empty host and path: no rule fits
    and it is allowed unless labels reject that template. Repeated rows count
    as often as they occur; ids are carried as they are.
    """
    settings = settings or Settings()
    url = F.col("url").cast("string")
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path")
    )
    rule, verdict = rule_verdict(rules, F.col("host"), F.col("path"))
    ruled = named.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"),
        segments(F.col("path"), settings).alias("parts"),
    )
    counted = ruled.select(
        "host",
        "parts",
        F.lit(1).alias("n"),
        F.col("ruled").isNotNull().cast("long").alias("labelled"),
        F.coalesce((F.col("ruled") == "block").cast("long"), F.lit(0)).alias("rejected"),
    )
    if labels is not None:
        address = F.col("url").cast("string")
        counted = counted.unionByName(
            labels.filter("rejected is not null").select(
                host(address).alias("host"),
                segments(path(address), settings).alias("parts"),
                F.lit(0).alias("n"),
                F.lit(1).cast("long").alias("labelled"),
                F.col("rejected").cast("long").alias("rejected"),
            )
        )
    paths = materialize(
        counted.groupBy("host", "parts").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "rejected")]),
        "paths",
    )
    known = materialize(templates(paths, settings), "templates")
    method = F.when(F.col("purity") >= settings.purity, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(known, ["host", "parts"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity"
    )
