"""Saved models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel


def save_model(model: PipelineModel, path: str) -> str:
    """Vectorizer and classifier are stages of one pipeline, so one folder holds both."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_models(paths: Mapping[str, str]) -> dict[str, PipelineModel]:
    """The models that exist; an absent path is left out."""
    found = {}
    for name, path in paths.items():
        try:
            found[name] = load_model(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return found
