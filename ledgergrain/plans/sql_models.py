"""Models given as SQL texts: order them by the models they name, put frames in, and run them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgergrain.plans.build import ModelSpec, build_all
from ledgergrain.plans.lineage import CALL, lineage
from ledgergrain.sources.tables import guarded_sql

QUOTED = re.compile(r"""'([^'"]+)'|"([^'"]+)\"""")


def table_of(call: str) -> str:
    """The table that a call stands for: the model of a ref, the table of a source."""
    return [a or b for a, b in QUOTED.findall(call)][-1].strip()


def plain_sql(text: str) -> str:
    """The text with plain table names in the place of calls."""
    return re.sub(CALL, lambda call: f" {table_of(call[0])} ", text)


def specs(texts: DataFrame) -> list[ModelSpec]:
    """Model specs from a table of ``model`` and ``text``; parents are read from the texts.

    Model texts are configuration, so they come to the driver, as plans do.
    """
    parents: dict[str, list[str]] = {}
    for edge in lineage(texts).orderBy("model", "in_braces", "part", "position").collect():
        parents.setdefault(edge.model, []).append(edge.parent.rsplit(".", 1)[-1])

    def spec(name: str, text: str) -> ModelSpec:
        needed = tuple(dict.fromkeys(parents.get(name, ())))

        def build(*frames: DataFrame) -> DataFrame:
            return guarded_sql(frames[0].sparkSession, plain_sql(text), dict(zip(needed, frames, strict=True)))

        return ModelSpec(name, needed, build, text)

    return [spec(r.model, r.text) for r in texts.orderBy("model").collect()]


def build_texts(spark: SparkSession, texts: DataFrame, tables: dict[str, DataFrame], folder: str, **options) -> DataFrame:
    """Run the models in order, write the last ones below ``folder``, and return one status row per model."""
    return build_all(spark, tables, specs(texts), folder, **options)
