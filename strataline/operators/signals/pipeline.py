"""All detectors as one operator."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame

from strataline.operators.signals import adoption, breaking, churn, fix_chain, ownership, revert, stability
from strataline.schema import SignalsConfig


class Detector(Protocol):
    def __call__(self, history: DataFrame, as_of: Column, config: SignalsConfig) -> DataFrame: ...


DETECTORS: dict[str, Detector] = {
    "revert": revert.detect, "churn": churn.detect, "ownership": ownership.detect, "fix_chain": fix_chain.detect,
    "adoption": adoption.detect, "stability": stability.detect, "breaking": breaking.detect,
}
#: What an incremental analysis recomputes, and the signal types that it replaces.
INCREMENTAL = ("churn", "ownership")
INCREMENTAL_TYPES = ("churn_hotspot", "ownership")


def detect(history: DataFrame, as_of: Column, config: SignalsConfig = SignalsConfig(), names=None) -> DataFrame:
    """The union of the named detectors' signals (all by default). Detectors are independent of each other."""
    return reduce(DataFrame.unionByName, [DETECTORS[n](history, as_of, config) for n in names or DETECTORS])
