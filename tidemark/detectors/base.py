"""The detector contract: a feature frame in, one score in [0, 1] per row out."""

from __future__ import annotations

from typing import Any, ClassVar

from pyspark.sql import DataFrame

from tidemark.frame import Frame
from tidemark.operators import normalise
from tidemark.session import materialise


class Detector:
    """Subclasses compute ``raw_scores``; the base class maps them to [0, 1].

    ``normaliser`` is ``minmax``, ``above_one``, ``none`` or a pair of quantiles.
    """

    name: ClassVar[str] = ""
    defaults: ClassVar[dict[str, Any]] = {}
    normaliser: ClassVar[Any] = "minmax"

    def __init__(self, **options):
        unknown = set(options) - set(self.defaults)
        if unknown:
            raise ValueError(f"{self.name}: unknown options {sorted(unknown)}")
        self.options = {**self.defaults, **options}
        self.fitted = False

    def raw_scores(self, frame: Frame) -> DataFrame:
        """Columns row_id, raw; larger is more anomalous."""
        raise NotImplementedError

    def fit_predict(self, frame: Frame) -> DataFrame:
        """Columns row_id, score."""
        if frame.n == 0:
            spark = frame.df.sparkSession
            return spark.createDataFrame([], "row_id bigint, score double")
        # scoring runs once; the normaliser reads the small written table
        raw = materialise(self.raw_scores(frame).select("row_id", "raw"), f"raw-{self.name}")
        self.fitted = True
        return self.normalise(raw).select("row_id", "score")

    def normalise(self, raw: DataFrame) -> DataFrame:
        if self.normaliser == "minmax":
            return normalise.minmax(raw)
        if self.normaliser == "above_one":
            return normalise.above_one(raw)
        if self.normaliser == "none":
            return raw.withColumnRenamed("raw", "score")
        return normalise.quantile_clip(raw, *self.normaliser)

    def describe(self) -> dict[str, Any]:
        return {"name": self.name, "options": dict(self.options), "fitted": self.fitted}
