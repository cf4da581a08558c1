"""Names, categories and requirements of detectors, including user-defined ones."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.detectors import neural, statistical, temporal
from tidemark.detectors.base import Detector


@dataclass(frozen=True)
class Requirements:
    min_samples: int = 10
    supports_multivariate: bool = True
    supports_streaming: bool = False
    memory_efficient: bool = True
    dependencies: tuple[str, ...] = ("numpy", "pyspark")


@dataclass(frozen=True)
class Entry:
    name: str
    category: str
    requirements: Requirements
    detector: type[Detector]


_REGISTRY: dict[str, Entry] = {}


def register_detector(name: str, category: str, requirements: Requirements, cls: type[Detector]) -> None:
    if not issubclass(cls, Detector):
        raise TypeError("a detector must subclass Detector")
    _REGISTRY[name] = Entry(name, category, requirements, cls)


def unregister_detector(name: str) -> None:
    """Forget a detector; unknown names are no error."""
    _REGISTRY.pop(name, None)


# fixed values: minimum rows and capabilities of the twelve detectors
for _name, _category, _need, _cls in (
    ("isolation_forest", "statistical", Requirements(10), statistical.IsolationForest),
    ("pca", "statistical", Requirements(50), statistical.PcaDetector),
    ("one_class_svm", "statistical", Requirements(20, memory_efficient=False), statistical.OneClassSvm),
    ("local_outlier_factor", "statistical", Requirements(20), statistical.LocalOutlierFactor),
    ("dbscan", "statistical", Requirements(10), statistical.Dbscan),
    ("gaussian_mixture", "statistical", Requirements(50), statistical.GaussianMixtureDetector),
    ("autoencoder", "deep_learning", Requirements(100, memory_efficient=False), neural.Autoencoder),
    ("lstm_autoencoder", "deep_learning",
     Requirements(200, supports_streaming=True, memory_efficient=False), neural.LstmAutoencoder),
    ("transformer", "deep_learning",
     Requirements(500, supports_streaming=True, memory_efficient=False), neural.Transformer),
    ("prophet", "time_series", Requirements(100, supports_multivariate=False), temporal.Prophet),
    ("arima", "time_series", Requirements(50, supports_multivariate=False), temporal.Arima),
    ("seasonal_decompose", "time_series",
     Requirements(100, supports_multivariate=False), temporal.SeasonalDecompose),
):
    register_detector(_name, _category, _need, _cls)


def names() -> list[str]:
    return list(_REGISTRY)


def entry(name: str) -> Entry:
    if name not in _REGISTRY:
        raise ValueError(f"unknown model {name}; available: {names()}")
    return _REGISTRY[name]


def create(name: str, **options) -> Detector:
    return entry(name).detector(**options)


def by_category() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for e in _REGISTRY.values():
        out.setdefault(e.category, []).append(e.name)
    return out


def registry_table(spark: SparkSession) -> DataFrame:
    """The registry as a table, in registration order."""
    rows = [
        (i, e.name, e.category, *(list(v) if isinstance(v, tuple) else v for v in asdict(e.requirements).values()))
        for i, e in enumerate(_REGISTRY.values())
    ]
    return spark.createDataFrame(
        rows,
        "position int, model string, category string, min_samples int, supports_multivariate boolean, "
        "supports_streaming boolean, memory_efficient boolean, dependencies array<string>",
    )
