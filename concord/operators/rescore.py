"""Rescoring stored results under other rules; the paths are not needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.rules import CURRENT, HOUR_BUCKETS, UNSPECIFIED, RuleSet
from concord.functions.text import classify_text
from concord.operators.dictionary import TextDictionary
from concord.operators.score import score

OVERRIDDEN = ("long_intent", "lat_intent", "long_match", "lat_match", "mismatch_score", "mismatch_type", "confidence")


def rescore(results: DataFrame, rules: RuleSet = CURRENT, keep_old: bool = False, known: TextDictionary | None = None) -> DataFrame:
    """results with seven fields made anew from their stored text; error rows pass unscored.

    keep_old adds old_<field> for the comparisons. known: a dictionary of these rules, in which the texts are looked up; only those
    that it doesn't have are classified.
    """
    renamed = results.withColumnsRenamed({c: f"old_{c}" for c in OVERRIDDEN})
    new = score(known.classify(renamed) if known else classify_text(renamed, "cot_text", rules))
    scored = F.col("error").isNull() if "error" in results.columns else F.lit(True)
    new = new.withColumns({c: F.when(scored, F.col(c)) for c in OVERRIDDEN})
    return new.select(*results.columns, *[f"old_{c}" for c in OVERRIDDEN if keep_old])


def changed() -> Column:
    """The type or an intent differs; a score alone does not count."""
    out = F.lit(False)
    for c in ("mismatch_type", "long_intent", "lat_intent"):
        out = out | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return out


def reclassified(pairs: DataFrame) -> DataFrame:
    return pairs.where(changed()).select("clip_id", "cot_text", *[c for n in ("mismatch_type", "long_intent", "lat_intent") for c in (f"old_{n}", n)])


def reclassified_preview(pairs: DataFrame, n: int = 20) -> DataFrame:
    """The first reclassified clips with the head of their text."""
    rows = reclassified(pairs).orderBy("clip_id").limit(n)
    return rows.select("clip_id", F.substring("cot_text", 1, 80).alias("text_80"), F.substring("cot_text", 1, 65).alias("text_65"), "old_mismatch_type", "mismatch_type")


def rescore_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.count_if(changed()).alias("n_changed"))


def type_shift(pairs: DataFrame) -> DataFrame:
    """Types before and after with counts, percentages and difference; a type absent on one side counts 0."""
    side = lambda c, n: pairs.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("mismatch_type")).agg(F.count("*").alias(n))
    both = side("old_mismatch_type", "n_old").join(side("mismatch_type", "n_new"), "mismatch_type", "full").na.fill(0)
    total = pairs.agg(F.count("old_mismatch_type").alias("all_old"), F.count("mismatch_type").alias("all_new"))  # one row
    rows = both.join(F.broadcast(total))
    share = lambda n, t: F.coalesce(100.0 * F.col(n) / F.nullif(F.col(t), F.lit(0)), F.lit(0.0))
    return rows.select("mismatch_type", "n_old", "n_new", share("n_old", "all_old").alias("pct_old"), share("n_new", "all_new").alias("pct_new"), (F.col("n_new") - F.col("n_old")).alias("delta")).orderBy("mismatch_type")


def unspecified_shift(pairs: DataFrame) -> DataFrame:
    """Unspecified intents before and after, by axis."""
    n = lambda c: F.count_if(F.col(c) == UNSPECIFIED)
    one = pairs.agg(*[n(f"{o}{a}_intent").alias(f"{o}{a}") for a in ("long", "lat") for o in ("old_", "")])
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"old_{a}").alias("n_before"), F.col(a).alias("n_after")) for a in ("long", "lat")])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("delta", F.col("n_after") - F.col("n_before"))


def classifiable_means(results: DataFrame) -> DataFrame:
    rows = results.where("mismatch_type is not null and mismatch_type <> 'unclassified_intent'")
    return rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in ("mismatch_score", "long_match", "lat_match", "ade_meters")])


def by_scenario(results: DataFrame) -> DataFrame:
    """Means by hour bucket from night to evening, with the unclassified counted; other scenarios are left out."""
    place = F.lit(None).cast("int")
    for i, (name, _, _) in enumerate(HOUR_BUCKETS):
        place = F.when(F.col("scenario_type") == name, i).otherwise(place)
    rows = results.withColumn("place", place).where("place is not null and mismatch_score is not null")
    return rows.groupBy("scenario_type", "place").agg(F.count("*").alias("n"), F.avg("mismatch_score").alias("mean_score"), F.avg("ade_meters").alias("mean_ade"), F.count_if(F.col("mismatch_type") == "unclassified_intent").alias("n_unclassified")).orderBy("place")
