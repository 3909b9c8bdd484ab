"""Labelled sample texts from phrase, filler and template tables.

Every choice is a hash of (seed, sample id, slot), so samples are made in
parallel, in the row, and a sample never depends on any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.fixed_values import (
    BOUNDARY_TEXTS, LEVELS, STARTER_FILLERS, STARTER_PHRASES, STARTER_TEMPLATES,
)
from veilmark.levels import level_name

NOISE = 0.5
TEMPLATE_NOISE = 0.2


class Sampler:
    """Column expressions for one generated text per row.

    ``phrases`` and ``templates`` map a level index to a list of strings.
    """

    def __init__(
        self,
        seed: int = 42,
        phrases: dict[int, list[str]] | None = None,
        fillers: list[str] | None = None,
        templates: dict[int, list[str]] | None = None,
        sample_id: str = "sample_id",
        label: str = "label_idx",
    ) -> None:
        self.seed = seed
        self.id, self.label = F.col(sample_id), F.col(label)
        self.phrases = self._table(phrases or STARTER_PHRASES)
        self.templates = self._table(templates or STARTER_TEMPLATES)
        self.fillers = F.lit(fillers or STARTER_FILLERS)

    @staticmethod
    def _table(by_level: dict[int, list[str]]) -> Column:
        return F.array(*[F.lit(by_level[k]) for k in range(len(LEVELS))])

    def digest(self, slot: str, *more: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(self.seed)), self.id, F.lit(slot), *more))

    def chance(self, slot: str) -> Column:
        """A number in [0, 1)."""
        return F.conv(F.substring(self.digest(slot), 1, 8), 16, 10).cast("double") / 4294967296.0

    def number(self, slot: str, low: int, high: int) -> Column:
        return (F.lit(low) + F.floor(self.chance(slot) * (high - low + 1))).cast("int")

    def shuffled(self, items: Column, slot: str) -> Column:
        keyed = F.transform(
            items, lambda s, i: F.struct(self.digest(slot, i.cast("string")).alias("h"), s.alias("s"))
        )
        return F.transform(F.sort_array(keyed), lambda x: x["s"])

    def own_phrases(self) -> Column:
        return self.shuffled(F.get(self.phrases, self.label), "signal")

    def foreign_phrase(self) -> Column:
        other = (self.label + 1 + F.floor(self.chance("other") * (len(LEVELS) - 1))) % len(LEVELS)
        pool = F.get(self.phrases, other.cast("int"))
        return F.get(pool, F.floor(self.chance("stray") * F.size(pool)).cast("int"))

    @staticmethod
    def _sentence(parts: Column) -> Column:
        text = F.array_join(parts, " ")
        head = F.upper(F.substring(text, 1, 1))
        return F.concat(head, F.lower(F.substr(text, F.lit(2))), F.lit("."))

    def phrase_text(self) -> Column:
        """3-6 phrases, half the time one of another level, 3-5 fillers, shuffled."""
        own = F.slice(self.own_phrases(), F.lit(1), self.number("signals", 3, 6))
        stray = F.when(self.chance("noise") < NOISE, F.array(self.foreign_phrase())).otherwise(
            F.array().cast("array<string>")
        )
        fill = F.slice(self.shuffled(self.fillers, "filler"), F.lit(1), self.number("fillers", 3, 5))
        return self._sentence(self.shuffled(F.concat(own, stray, fill), "order"))

    def long_text(self) -> Column:
        """4-7 phrases and 4-6 fillers, shuffled, no noise."""
        own = F.slice(self.own_phrases(), F.lit(1), self.number("long signals", 4, 7))
        fill = F.slice(self.shuffled(self.fillers, "filler"), F.lit(1), self.number("long fillers", 4, 6))
        return self._sentence(self.shuffled(F.concat(own, fill), "order"))

    def template_text(self) -> Column:
        """A template with two phrases and two fillers; sometimes a stray note."""
        pool = F.get(self.templates, self.label)
        text = F.get(pool, F.floor(self.chance("template") * F.size(pool)).cast("int"))
        own, fill = self.own_phrases(), self.shuffled(self.fillers, "filler")
        for mark, source, at in (("{s0}", own, 0), ("{s1}", own, 1), ("{f0}", fill, 0), ("{f1}", fill, 1)):
            text = F.replace(text, F.lit(mark), F.get(source, at))
        note = F.concat(F.lit(" Note: "), self.foreign_phrase(), F.lit("."))
        return F.concat(text, F.when(self.chance("note") < TEMPLATE_NOISE, note).otherwise(F.lit("")))

    def text(self) -> Column:
        """40 % phrases, 40 % template, 20 % long."""
        mode = self.chance("mode")
        return (
            F.when(mode < 0.4, self.phrase_text())
            .when(mode < 0.8, self.template_text())
            .otherwise(self.long_text())
        )


def boundary_rows(spark: SparkSession, cases: DataFrame | None = None) -> DataFrame:
    """``(text, label_idx)`` of fixed boundary cases."""
    return cases if cases is not None else spark.createDataFrame(BOUNDARY_TEXTS, "text string, label_idx int")


def with_labels(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", level_name(F.col("label_idx")))


def generate(
    spark: SparkSession, n_labelled: int = 150, n_unlabelled: int = 50, seed: int = 42,
    boundary: DataFrame | None = None, **tables,
) -> DataFrame:
    """The full set: boundary cases, then per level labelled and unlabelled samples.

    Unlabelled rows have null ``label_idx`` and ``label``. Rows come in hash order.
    """
    per_level = n_labelled + n_unlabelled
    ids = spark.range(per_level * len(LEVELS)).select(
        F.col("id").alias("sample_id"),
        F.floor(F.col("id") / per_level).cast("int").alias("label_idx"),
        (F.col("id") % per_level < n_labelled).alias("labelled"),
    )
    sampler = Sampler(seed, **tables)
    made = ids.select(
        sampler.text().alias("text"),
        F.when(F.col("labelled"), F.col("label_idx")).alias("label_idx"),
    )
    both = with_labels(made.unionByName(boundary_rows(spark, boundary)))
    return both.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "text")))
