"""Classification jobs with a caller's classifier; the default one is a rule over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from . import repository

Classifier = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

#: Words that speak for a category, for the rule.
KEYWORDS = {"kubernetes": ["kubernetes", "cluster"], "rag": ["retrieval", "rag"], "testing": ["test", "bolt"], "databases": ["database", "gear"], "cli-tools": ["cli", "widget"]}


#: What a caller's templates may name; the defaults hold nothing but these.
USER = "{full_name}; {language}; {topics}; {stars}, {trend}\n{description}\n\n{readme}"
SYSTEM = "{categories}"


def prompts(repos: DataFrame, readmes: DataFrame, chars: int = 2000, user: str = USER, system: str = SYSTEM, categories: list[str] = ()) -> DataFrame:
    """Prompts of each repository by the caller's templates; readmes: full_name, content."""
    rows = repos.join(readmes, "full_name", "left").withColumn("content", F.coalesce("content", F.lit("")))
    fields = {
        "full_name": F.col("full_name"), "description": F.col("description"), "language": F.col("language"), "topics": F.replace(F.col("topics_text"), F.lit(" "), F.lit(", ")),
        "stars": F.col("stars").cast("string"), "trend": x.trend(F.col("star_velocity")), "readme": x.shortened(F.col("content"), chars), "categories": F.lit(", ".join(categories)),
    }
    return rows.select("full_name", x.rendered(user, fields).alias("prompt"), x.rendered(system, fields).alias("system"), x.content_hash(F.col("content")).alias("hash"))


def by_keywords(rows: DataFrame) -> DataFrame:
    """The rule: the first category with a word in the prompt, confidence 0.8; other, 0.3."""
    low = F.lower("prompt")
    category = F.lit(None).cast("string")
    for name, words in reversed(KEYWORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        category = F.when(hit, name).otherwise(category)
    return rows.select("full_name", F.coalesce(category, F.lit("other")).alias("category"), F.when(category.isNull(), F.lit(0.3)).otherwise(F.lit(0.8)).alias("confidence"))


def classify(repos: DataFrame, readmes: DataFrame, least: float = 0.6, classifier: Classifier | None = None) -> DataFrame:
    """Results for the repositories that need classification: category, confidence, status, hash.

    A caller's classifier gets batches of (full_name, prompt) in pandas and gives
    (full_name, category, confidence).
    """
    asked = prompts(repos.filter(repository.needs_classification()), readmes)
    if classifier is None:
        found = by_keywords(asked)
    else:
        found = asked.select("full_name", "prompt").mapInPandas(classifier, "full_name string, category string, confidence double")
    return found.join(asked.select("full_name", "hash"), "full_name").withColumn("status", x.status_of(F.col("confidence"), least))


def summary(results: DataFrame) -> DataFrame:
    from .health import run_result

    out = results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("classified"), F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("category").isNull()).alias("failed"),
    )
    return out.withColumn("result", run_result(F.col("failed"), F.col("classified")))
