"""Every registered query of the engine and the SQL that has to give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendspan.plans import admin, answers, batch, collected, contexts, curation, decisions, feeds, identity, landing, ranking, served, store, texts

_PARTS = [store.R, texts.R, ranking.R, feeds.R, curation.R, served.R, collected.R, identity.R, landing.R, admin.R, contexts.R, batch.R, decisions.R, answers.R]

QUERIES = {name: q for part in _PARTS for name, q in part.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.oracles.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.hot_keywords(spark, sf_dir)
