"""Detectors of a session: what takes the place of a built-in one, and what votes beside them.

A detector is a function that adds a signal (``scorers.SIGNAL``) to analysed names, in a column of its own name. One that is
registered under a built-in detector's name is used in its place; any other is fused with its own weight. What voted can
be told from ``provenance``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.operators.fusion import SIGNALS
from tidewarden.policy import POLICY, Policy


@dataclass(frozen=True)
class Detector:
    """``add``: names with name, cls, feat and intel, to the same with a column ``name``; ``weight``: None for the policy's."""

    name: str
    add: Callable[[DataFrame], DataFrame]
    weight: float | None = None
    version: str = "1"
    description: str = ""


#: Built-in detectors, in the order of fusion.
BUILT_IN = {"ti": "names listed by threat intelligence", "dga": "letter pairs, words and digits of the registrant's label", "lexical": "rules on a name's shape and words", "tunnel": "carried data in what a name's holder controls", "behavioral": "history of the registrable domain"}

_registered: dict[str, dict[str, Detector]] = {}


def _session(spark: SparkSession) -> dict[str, Detector]:
    return _registered.setdefault(spark._jsparkSession.sessionUUID(), {})


def register(spark: SparkSession, detector: Detector) -> None:
    """From now on ``analysis.analyze`` uses the detector in this session; one of the same name before it is replaced."""
    if detector.name not in SIGNALS and detector.weight is None:
        raise ValueError("a detector beside the built-in ones needs a weight")
    if not detector.name.isidentifier() or detector.name.startswith("_") or detector.name in ("name", "cls", "feat", "intel", "assessment", "override", "none"):
        raise ValueError(f"no name for a detector: {detector.name}")
    _session(spark)[detector.name] = detector


def unregister(spark: SparkSession, name: str) -> None:
    """The built-in detector of this name is back, if there is one."""
    _session(spark).pop(name, None)


def replacing(spark: SparkSession, name: str) -> Detector | None:
    return _session(spark).get(name)


def beside(spark: SparkSession) -> list[Detector]:
    """Detectors that vote beside the built-in ones, in the order they were registered."""
    return [d for n, d in _session(spark).items() if n not in SIGNALS]


def weights(spark: SparkSession, policy: Policy = POLICY) -> dict[str, float]:
    """The weight of each detector that votes in this session, in the order of fusion."""
    out = {n: policy.get("weights")[n] for n in SIGNALS}
    return out | {n: d.weight for n, d in _session(spark).items() if d.weight is not None}


def provenance(spark: SparkSession, policy: Policy = POLICY) -> DataFrame:
    """Rows (name, origin, version, weight, description) of the detectors that vote in this session."""
    rows = []
    for n, w in weights(spark, policy).items():
        d = replacing(spark, n)
        rows.append((n, "registered" if d else "built in", d.version if d else "1", float(w), d.description if d else BUILT_IN[n]))
    return spark.createDataFrame(rows, "name string, origin string, version string, weight double, description string")


def votes(assessed: DataFrame) -> DataFrame:
    """Rows (domain, signal, contribution, factors): what each detector added to each name's score; overrides are a row too."""
    each = assessed.select(F.col("name.domain").alias("domain"), F.explode("assessment.factors").alias("f"))
    return each.groupBy("domain", F.col("f.signal").alias("signal")).agg(F.sum("f.contribution").alias("contribution"), F.count(F.lit(1)).alias("factors"))
