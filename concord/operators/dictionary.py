"""A dictionary of texts: each different text is classified once, ever, and looked up from then on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.rules import CURRENT, UNSPECIFIED, RuleSet, fingerprint
from concord.functions.text import classify_text
from concord.sources.log import BatchLog

_INTENTS = ("long_intent", "lat_intent", "confidence")
ENTRIES = T.StructType([T.StructField(n, T.DoubleType() if n == "confidence" else T.StringType()) for n in ("text_key", "cot_text", *_INTENTS)])


def text_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class TextDictionary:
    """Intents of texts under one rule set, kept at path as batches of a log (other rule sets have their own entries there).

    Texts are brought down to different ones before they are shuffled, so that a text that every clip has is one row a task.
    What is known is left out by key alone; only new texts meet the patterns. Texts of clips are joined with their entries
    by key: a key that many clips share lies on the side that Spark splits.
    """

    def __init__(self, spark: SparkSession, path: str, rules: RuleSet = CURRENT) -> None:
        self.rules = rules
        self.log = BatchLog(spark, f"{path.rstrip('/')}/rules={fingerprint(rules)}", ENTRIES)

    def _distinct(self, texts: DataFrame) -> DataFrame:
        rows = texts.where(F.col("cot_text").isNotNull()).select(text_key(F.col("cot_text")).alias("text_key"), "cot_text")
        return rows.groupBy("text_key").agg(F.first("cot_text").alias("cot_text"))

    def learn(self, texts: DataFrame) -> int:
        """Classify the texts that are not known yet; the number of the batch that holds them. Killed before its record, a
        batch counts for nothing and is made again."""
        known = self.log.records()
        number = known[-1] + 1 if known else 0
        new = self._distinct(texts).join(self.log.read().select("text_key"), "text_key", "left_anti")
        self.log.write(classify_text(new, rules=self.rules), number)
        self.log.commit(number)
        return number

    def classify(self, texts: DataFrame) -> DataFrame:
        """texts with long_intent, lat_intent and confidence, as classify_text gives them, after learning those that are new."""
        self.learn(texts)
        return self.look_up(texts)

    def look_up(self, texts: DataFrame) -> DataFrame:
        """texts with their intents; null intents for texts that aren't known, unspecified for null texts."""
        entries = self.log.read().select("text_key", *_INTENTS)
        rows = texts.withColumn("text_key", text_key(F.col("cot_text"))).join(entries, "text_key", "left").drop("text_key")
        without = F.col("cot_text").isNull()
        none = {"long_intent": F.lit(UNSPECIFIED), "lat_intent": F.lit(UNSPECIFIED), "confidence": F.lit(0.0)}
        return rows.withColumns({c: F.when(without, v).otherwise(F.col(c)) for c, v in none.items()})

    def report(self, texts: DataFrame, batch: int | None = None) -> DataFrame:
        """n_texts, n_distinct, and n_new: how many of those a batch (the last) has added."""
        batch = self.log.records()[-1] if batch is None else batch
        distinct = texts.where(F.col("cot_text").isNotNull()).groupBy(text_key(F.col("cot_text")).alias("text_key")).agg(F.count("*").alias("n"))
        added = self.log.read().where(F.col("batch") == batch).select("text_key", F.lit(1).alias("added"))
        rows = distinct.join(added, "text_key", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"), F.count("*").alias("n_distinct"), F.count("added").alias("n_new"))
        nulls = texts.where(F.col("cot_text").isNull()).agg(F.count("*").alias("n_null"))  # one row
        return rows.join(F.broadcast(nulls)).select((F.col("n_all") + F.col("n_null")).alias("n_texts"), "n_distinct", "n_new")
