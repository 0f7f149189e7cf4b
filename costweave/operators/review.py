"""Review of normalised descriptions: what they lost, verdicts, domain rules and quality figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD_BELOW, WARN_BELOW, LOSS_CRITICAL = 50, 70, 0.5  # fixed values: confidence in percent, share of lost specifications
POINTS = {"verb": 30, "material": 20, "position": 15, "detail": 15}  # fixed values: confidence lost with a missing part


@dataclass(frozen=True)
class Rule:
    """A text that matches ``when`` has to match ``check``; patterns are read in lower case."""

    name: str
    severity: str
    when: str
    check: str


@dataclass(frozen=True)
class Default:
    """``text`` goes for what a description that matches ``when`` leaves unsaid: it doesn't match ``said``, in lower case."""

    when: str
    said: str
    text: str


def with_defaults(column: str, defaults: list[Default]) -> Column:
    """The text and, joined by ' - ', the defaults that it needs; a null text needs none and becomes empty."""
    t = F.lower(column)
    return F.concat_ws(" - ", column, *(F.when(t.rlike(d.when) & ~t.rlike(d.said), d.text) for d in defaults))


def missing(original: str, normalised: str, pattern: str) -> Column:
    """Distinct matches of the pattern in the original that the normalised text lacks, both in upper case, sorted."""
    held = lambda c: F.regexp_extract_all(F.upper(F.coalesce(F.col(c), F.lit(""))), F.lit(pattern), F.lit(0))
    return F.array_sort(F.array_except(held(original), held(normalised)))


def verdicts(rows: DataFrame, specs: str, materials: str) -> DataFrame:
    """(original, normalised, confidence) rows with ``lost`` and ``verdict``: BAD, FIXABLE or GOOD.

    Null texts are empty, and an empty or very short result is BAD. Half of the specifications or less may be lost.
    """
    original, normalised = (F.coalesce(F.col(c), F.lit("")) for c in ("original", "normalised"))
    rows = rows.withColumns({"_specs": missing("original", "normalised", specs), "_materials": missing("original", "normalised", materials)})
    n_specs = F.size(F.array_distinct(F.regexp_extract_all(F.upper(original), F.lit(specs), F.lit(0))))
    parts, low = F.size(F.split(normalised, " - ")), F.col("confidence") < WARN_BELOW
    bad = (F.length(F.trim(normalised)) < 3) | (F.col("confidence") < BAD_BELOW) | ((parts == 1) & (F.length(normalised) > 15)) | (F.size("_specs") > n_specs * LOSS_CRITICAL)
    lost = F.concat("_specs", "_materials")
    fixable = low | (parts > 3) | (F.size(lost) > 0) | (low & (F.lower(F.trim(normalised)) == F.lower(F.trim(original))))
    verdict = F.when(F.coalesce(bad, F.lit(False)), "BAD").when(F.coalesce(fixable, F.lit(False)), "FIXABLE").otherwise("GOOD")
    return rows.withColumns({"lost": lost, "verdict": verdict}).drop("_specs", "_materials")


def validate(rows: DataFrame, rules: list[Rule], column: str = "description") -> DataFrame:
    """``rows`` with ``issues`` (name, severity) in the order of the rules and ``is_valid``: no issue is an error.

    Null texts are empty.
    """
    t = F.lower(F.coalesce(F.col(column), F.lit("")))
    broken = [F.when(t.rlike(r.when) & ~t.rlike(r.check), F.struct(F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"))) for r in rules]
    return rows.withColumn("issues", F.array_compact(F.array(*broken))).withColumn("is_valid", ~F.exists("issues", lambda i: i["severity"] == "error"))


def quality_metrics(validated: DataFrame, by: list[str]) -> DataFrame:
    """Items, share of valid ones in percent, mean confidence, errors and warnings of every group."""
    of = lambda s: F.sum(F.size(F.filter("issues", lambda i: i["severity"] == s)))
    return validated.groupBy(*by).agg(
        F.count("*").alias("n_items"), (F.count_if("is_valid") / F.count("*") * 100).alias("valid_rate"), (F.sum("confidence") / F.count("confidence")).alias("avg_confidence"), of("error").alias("n_errors"), of("warning").alias("n_warnings")
    )


def parts_confidence(verb: Column, material: Column, position: Column, detail: Column) -> Column:
    """100 less what each missing part (null or empty) costs."""
    parts = dict(zip(POINTS, (verb, material, position, detail), strict=True))
    return F.lit(100) - sum(F.when(F.coalesce(c, F.lit("")) == "", POINTS[name]).otherwise(0) for name, c in parts.items())
