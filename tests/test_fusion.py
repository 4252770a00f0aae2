import pytest
from pyspark.sql import functions as F

from tidewarden.operators.fusion import assess
from tidewarden.operators.scorers import SIGNAL


def assessed(spark, **signals):
    df = spark.range(1)
    for name in ("ti", "dga", "lexical", "tunnel", "behavioral"):
        score, confidence, verdict = (*signals.get(name, (0.0, 0.0)), None)[:3]
        codes = F.array(F.struct(F.lit(name.upper()), F.lit("low"), F.lit(float(score))))
        df = df.withColumn(name, F.struct(F.lit(name), F.lit(float(score)), F.lit(float(confidence)), F.lit(None), F.lit(verdict), codes).cast(SIGNAL))
    return assess(df).select("assessment.*").first()


@pytest.mark.parametrize(
    "signals, score, decision",
    [
        ({"dga": (80, 1)}, 80, "BLOCK"),
        ({"dga": (100, 1), "lexical": (0, 1)}, 58, "MONITOR"),
        ({"ti": (0, 0), "dga": (90, 1)}, 90, "BLOCK"),
        ({}, 0, "ALLOW"),
        ({"ti": (95, 0.98, "MALICIOUS"), "dga": (0, 0.8), "lexical": (0, 0.85)}, 85, "BLOCK"),
        ({"ti": (0, 0.9, "TRUSTED"), "lexical": (100, 0.85), "dga": (100, 0.8)}, 25, "ALLOW"),
    ],
)
def test_scores_and_their_explanation(spark, signals, score, decision):
    r = assessed(spark, **signals)
    assert (r.score, r.decision) == (score, decision)
    assert sum(f.contribution for f in r.factors) == pytest.approx(r.raw_score, abs=0.05)
    assert bool(signals) or r.factors[-1].code == "NO_EVIDENCE"
