"""Scoring of a stream of impressions by models that look at one impression at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clicklog.operators import models


def score_stream(impressions: DataFrame, model: models.RateModel | models.PositionBased) -> DataFrame:
    """``impressions`` is a streaming frame; parameters are static tables, joined stream-to-static."""
    if not isinstance(model, models.RateModel | models.PositionBased):
        raise TypeError("only models without a session history score a stream row by row")
    return model.score(impressions)
