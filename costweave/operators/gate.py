"""Quality gate of catalogue rows: rules as data, scores as one chain of built-in expressions, routing and its counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Points and gates.
POINTS, ACCEPTED_SCORE, SHORT_SCORE, MOST = 25, 75, 10, 100
APPROVED, PENDING = 90, 60


@dataclass(frozen=True)
class Category:
    """Indicators a category asks for, the bonus they earn, and the grade put in where a row names no specification."""

    least: int = 1
    bonus: int = 0
    grade: str | None = None


@dataclass(frozen=True)
class Rules:
    """Patterns (Java) of the gate, in the order they are tried. The indicator ``has_specs`` decides on default grades."""

    device: str
    forbidden: dict[str, str]
    accepted: dict[str, str]
    indicators: dict[str, str]
    categories: dict[str, Category] = field(default_factory=dict)
    general: Category = Category()
    least_length: int = 5


def _first(text, patterns: dict[str, str]) -> F.Column:
    """The name of the first pattern that a text holds, else null."""
    return F.coalesce(F.lit(None).cast("string"), *(F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()))


def _by_category(category, rules: Rules, of) -> F.Column:
    """A setting by category; unknown and null categories are general."""
    out = F.lit(of(rules.general))
    for name, entry in rules.categories.items():
        out = F.when(category == name, F.lit(of(entry))).otherwise(out)
    return out


def score(rows: DataFrame, rules: Rules, text: str = "description", category: str = "category") -> DataFrame:
    """``rows`` with status, score, reason, the matched indicators and the grade put in.

    Device codes are SKIPPED and forbidden texts REJECTED at 0, accepted materials APPROVED at 75, too short texts
    REJECTED at 10. Others get 25 points an indicator, the bonus of a category whose number of indicators they have, and
    25 for the category's grade if they name no specification and are below APPROVED; 100 at most. Null texts are empty.
    """
    t, c = F.trim(F.coalesce(F.col(text), F.lit(""))), F.col(category)
    found = F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(name)) for name, p in rules.indicators.items())))
    rows = rows.withColumns({"indicators": found, "_forbidden": _first(t, rules.forbidden), "_accepted": _first(t, rules.accepted)})
    n = F.size("indicators")
    base = n * POINTS + F.when(n >= _by_category(c, rules, lambda e: e.least), _by_category(c, rules, lambda e: e.bonus)).otherwise(0)
    grade = F.when((base < APPROVED) & ~F.array_contains("indicators", "has_specs"), _by_category(c, rules, lambda e: e.grade).cast("string"))
    total = F.least(F.lit(MOST), base + F.when(grade.isNotNull(), POINTS).otherwise(0))
    rows = rows.withColumns({"_grade": grade, "_total": total})
    # the first case that holds gives (status, score, reason, default grade)
    result = lambda status, points, reason, put: F.struct(F.lit(status).alias("status"), points.cast("int").alias("score"), reason.cast("string").alias("reason"), put.cast("string").alias("default_grade"))
    none = F.lit(None)
    scored = F.when(F.col("_total") >= APPROVED, "APPROVED").when(F.col("_total") >= PENDING, "PENDING_REVIEW").otherwise("REJECTED")
    case = (
        F.when(t.rlike(rules.device), result("SKIPPED", F.lit(0), F.lit("device code"), none))
        .when(F.col("_forbidden").isNotNull(), result("REJECTED", F.lit(0), F.concat(F.lit("forbidden: "), F.col("_forbidden")), none))
        .when(F.col("_accepted").isNotNull(), result("APPROVED", F.lit(ACCEPTED_SCORE), F.concat(F.lit("accepted: "), F.col("_accepted")), none))
        .when(F.length(t) < rules.least_length, result("REJECTED", F.lit(SHORT_SCORE), F.lit("too short"), none))
        .otherwise(F.struct(scored.alias("status"), F.col("_total").cast("int").alias("score"), F.when(scored == "REJECTED", "few indicators").alias("reason"), F.col("_grade").alias("default_grade")))
    )
    return rows.withColumn("_case", case).select("*", "_case.*").drop("_case", "_forbidden", "_accepted", "_grade", "_total")


def destination(rows: DataFrame) -> DataFrame:
    """``rows`` of ``score`` with where they go: master, pending, quarantine (forbidden or too short), a red work item, or nowhere."""
    garbage = F.col("reason").startswith("forbidden") | (F.col("reason") == "too short")
    to = F.when(F.col("status") == "APPROVED", "master").when(F.col("status") == "PENDING_REVIEW", "pending").when(F.col("status") == "SKIPPED", "skipped")
    return rows.withColumn("destination", to.when(garbage, "quarantine").otherwise("red work item"))


def quarantine_counts(rows: DataFrame) -> DataFrame:
    """Quarantined rows by reason; no reason counts as 'unknown'."""
    reason = F.coalesce("reason", F.lit("unknown")).alias("reason")
    # the few groups are filtered by an aggregate, which can't move below it: a filter on the rows would repeat all cases
    few = rows.groupBy("destination", reason).agg(F.count("*").alias("n"), F.max("destination").alias("to"))
    return few.where(F.col("to") == "quarantine").select("reason", "n")
