"""Structure, then the rules of the chosen classes: one table of issues, gated per dataset without an action in between."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Tolerances, Topology
from ..operators.rules import CLASSES, RULES
from ..sources import raw
from ..storage import stored
from . import structure as raw_structure
from .derive import D

ISSUE = ("dataset_id", "rule", "code", "severity", "object_id", "detail")


def structure(t: Topology) -> DataFrame:
    """Issues of structure: repeated ids, points with too few or non-numeric coordinates; a warning for datasets that are all 2D."""

    def issue(df: DataFrame, code: str, detail, severity: str = "error") -> DataFrame:
        return df.select(D, F.lit("Structure").alias("rule"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("id").alias("object_id"), F.col(detail).cast("string").alias("detail"))

    parts = []
    for name in ("point", "curve", "surface", "solid"):
        df = getattr(t, name)
        first = df.groupBy(D, "id").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = df.select(D, "id", "ord").join(first, [D, "id"]).where("ord > first")
        parts.append(issue(again, "DUPLICATE_ID", "ord"))
    p = t.point if "n" in t.point.columns else t.point.withColumn("n", F.when(F.col("z").isNull(), 2).otherwise(3))
    flat = p.groupBy(D).agg(F.bool_and((F.col("n") == 2) & F.col("x").isNotNull() & F.col("y").isNotNull()).alias("flat"))
    p = p.join(flat, D)
    parts.append(issue(p.where((F.col("n") < 3) & ~F.col("flat")), "INVALID_COORDINATES", "n"))
    parts.append(issue(p.where((F.col("n") >= 3) & (F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull())), "INVALID_COORDINATE_VALUE", "n"))
    parts.append(issue(flat.where("flat").withColumn("id", F.lit(None).cast("string")).withColumn("no", F.lit("")), "NO_3D_TOPOLOGY", "no", "warning"))
    return reduce(DataFrame.unionByName, parts)


def validate(t: Topology, tolerances: Tolerances | None = None, classes: Iterable[str] | None = None, progress: Callable[[str], None] | None = None, first: DataFrame | None = None) -> DataFrame:
    """All issues.  first: those of structure, if they are known already.  Datasets with an error of structure, or all in 2D, get no rule issues.  classes: ids like CC-01; none means all, unknown ones match nothing."""
    tol, chosen = tolerances or Tolerances(), set(classes or ())
    first = stored(structure(t) if first is None else first.select(*ISSUE))
    stop = first.select(D).distinct()
    parts = [first]
    for number in CLASSES:
        group = f"CC-{number:02d}"
        if chosen and group not in chosen:
            continue
        if progress:
            progress(f"{group} {CLASSES[number]}")
        parts += [f(t, tol).join(stop, D, "left_anti") for _, g, f in RULES.values() if g == group]
    return reduce(DataFrame.unionByName, parts).select(*ISSUE)


def validate_raw(docs: DataFrame, tolerances: Tolerances | None = None, classes: Iterable[str] | None = None, progress: Callable[[str], None] | None = None) -> DataFrame:
    """All issues of models in their raw form (dataset_id, doc): structure, then the rules where structure is sound."""
    first = stored(raw_structure.structure_issues(docs))
    t = raw.load(docs.join(first.select(D).distinct(), D, "left_anti")).kept()
    return validate(t, tolerances, classes, progress, first)


def datasets(t: Topology) -> DataFrame:
    """The ids of all datasets that have any record."""
    return reduce(DataFrame.unionByName, [getattr(t, f.name).select(D) for f in fields(t)]).distinct()


def rule_table(spark: SparkSession) -> DataFrame:
    """Structure and the rules, in the order of reports: ord, rule, name, class."""
    table = [("Structure", "Structure", "")] + [(r, *RULES[r][:2]) for r in sorted(RULES)]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(table)], "ord int, rule string, name string, class string")


def rule_results(issues: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per dataset and rule: name, class, status (FAIL, WARN, PASS), issues and errors.

    known: the ids of all datasets (``datasets``); without it those that have issues, so that valid ones are not listed.
    """
    rules = rule_table(issues.sparkSession)
    counts = issues.groupBy(D, "rule").agg(F.count(F.lit(1)).alias("issues"), F.count_if(is_error()).alias("errors"))
    known = issues.select(D) if known is None else known.select(D)
    every = known.distinct().join(F.broadcast(rules))
    out = every.join(counts, [D, "rule"], "left").na.fill(0, ["issues", "errors"])
    return out.withColumn("status", F.when(F.col("errors") > 0, "FAIL").when(F.col("issues") > 0, "WARN").otherwise("PASS"))


def is_error() -> Column:
    """Issues without a severity are errors."""
    return F.coalesce("severity", F.lit("error")) == "error"


def errors_only(issues: DataFrame) -> DataFrame:
    return issues.where(is_error())


def has_error(issues: DataFrame, code: str) -> DataFrame:
    """Per dataset with issues: whether one of them has the code."""
    return issues.groupBy(D).agg(F.bool_or(F.col("code") == code).alias("found"))


def findings(issues: DataFrame) -> DataFrame:
    """Issues as findings of a validation host: message, is_error and payload (JSON)."""
    text = F.concat_ws(" ", F.concat(F.col("code"), F.lit(":")), "object_id", F.expr("nullif(detail, '')"))
    return issues.select(D, text.alias("message"), is_error().alias("is_error"), F.to_json(F.struct(*[c for c in ISSUE if c != D])).alias("payload"))
