"""Geometry-aware retrieval analytics on Spark DataFrames."""

from importlib import import_module

__version__ = "0.2.0"

#: Name -> module that has it; imported when first asked for.
_EXPORTS = {
    "GeoIndex": "lodestar.plans.retriever",
    "Retriever": "lodestar.plans.retriever",
    "ExperimentConfig": "lodestar.plans.config",
    "quick_experiment": "lodestar.plans.experiments",
    "load_encoder": "lodestar.functions.encoders",
    "registry": "lodestar.functions.registry",
    "make_judges": "lodestar.functions.judges",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(import_module(_EXPORTS[name]), name)
