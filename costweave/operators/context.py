"""Context of a file from all its lines: project type by keyword scores, and the terms that it uses most."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEAK, CLEAR = 0.5, 0.3  # fixed values: weight of a weak keyword, the share that makes a type significant


@dataclass(frozen=True)
class Indicators:
    strong: list[str]
    weak: list[str]
    weight: float


def project_types(lines: DataFrame, key: str, types: dict[str, Indicators], text: str = "description") -> DataFrame:
    """(key, project_type, share, gap): the type with the largest share of a file's keyword scores.

    ``mixed`` if no share reaches CLEAR or the second one exceeds it too; ``gap`` is the distance to the second. Scores
    are sums of a row's own keywords, so they are added before rows move. Ties go by the order of the types.
    """
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = lambda w, points: F.when(F.contains(t, F.lit(w)), F.lit(float(points))).otherwise(0.0)
    score = {name: sum(([hit(w, i.weight) for w in i.strong] + [hit(w, WEAK) for w in i.weak]), F.lit(0.0)) for name, i in types.items()}
    sums = lines.groupBy(key).agg(*(F.sum(c).alias(f"_{name}") for name, c in score.items()))
    total = sum((F.col(f"_{name}") for name in types), F.lit(0.0))
    share = lambda name: F.when(total > 0, F.col(f"_{name}") / total).otherwise(0.0)
    ranked = sums.withColumn("_r", F.sort_array(F.array(*(F.struct(share(n).alias("share"), F.lit(-k).alias("order"), F.lit(n).alias("name")) for k, n in enumerate(types))), asc=False))
    best, second = F.col("_r")[0], F.coalesce(F.try_element_at("_r", F.lit(2))["share"], F.lit(0.0))
    mixed = (best["share"] < CLEAR) | (second > CLEAR)
    return ranked.select(key, F.when(mixed, "mixed").otherwise(best["name"]).alias("project_type"), best["share"].alias("share"), (best["share"] - second).alias("gap"))


def top_terms(lines: DataFrame, keys: list[str], terms: list[str], k: int, text: str = "description") -> DataFrame:
    """(keys, place, term, n): the k terms that most lines of a group hold as words, ties by term.

    Terms are configuration, so counts of a group are few whatever its number of lines.
    """
    words = F.array_intersect(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, terms)))
    counts = lines.select(*keys, F.explode(words).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "term"))
    return counts.withColumn("place", place).where(F.col("place") <= k)
