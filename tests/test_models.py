"""Stored models, registered detectors, files of several ages."""

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import detectors, models, scorers
from tidewarden.plans import analysis
from tidewarden.sources import event_store, schema_history


def test_models_are_stored_by_version(spark, tmp_path):
    path = str(tmp_path / "models")
    assert models.versions(spark, path).count() == 0
    with pytest.raises(LookupError):
        models.load(spark, path)
    (tmp_path / "corpus.txt").write_text("# names\nriver.example.com stone\nforest.com  bad..name\nriver.org\n")
    labels = models.corpus(spark, str(tmp_path / "corpus.txt"))
    assert {r.label for r in labels.collect()} == {"example", "stone", "forest", "river"}
    first, second = models.train(labels), models.train(labels.where("label <> 'stone'"))
    assert [models.save(spark, m, path) for m in (first, second)] == [1, 2]
    last = models.load(spark, path)
    assert last["log_probs"] == second["log_probs"] and (last["mean"], last["corpus_size"], last["version"]) == (second["mean"], 3, 2)
    assert models.load(spark, path, 1)["log_probs"] == first["log_probs"]
    raw = spark.createDataFrame([("riverstone.com",), ("xqzjkwv.com",)], "raw string")
    by = lambda m: {r.raw: r.dga.score for r in scorers.dga(analysis.features(raw), m).collect()}
    assert by(models.load(spark, path, 1)) == by(first) != by(last)


def test_detectors_of_a_session(spark):
    raw = spark.createDataFrame([("quiet.example.com",), ("loud.example.com",)], "raw string")

    def loud(df):
        struct = F.struct(F.lit("volume").alias("name"), F.when(F.col("raw").startswith("loud"), 90.0).otherwise(0.0).alias("score"), F.lit(0.9).alias("confidence"), F.lit("volume").alias("scope_key"), F.lit("SCORED").alias("verdict"), F.array().alias("factors"))
        return df.withColumn("volume", struct.cast(scorers.SIGNAL))

    def silent(df):
        return df.withColumn("lexical", F.lit(None).cast(scorers.SIGNAL))

    before = {r.raw: r.assessment.raw_score for r in analysis.analyze(raw).collect()}
    detectors.register(spark, detectors.Detector("volume", loud, 0.5, "3", "how loud a name is"))
    detectors.register(spark, detectors.Detector("lexical", silent))
    try:
        out = analysis.analyze(raw)
        got = {r.raw: r.assessment.raw_score for r in out.collect()}
        assert got["loud.example.com"] > before["loud.example.com"] and got["quiet.example.com"] <= before["quiet.example.com"]
        votes = {(r.domain, r.signal): r.contribution for r in detectors.votes(out).collect()}
        assert votes["loud.example.com", "volume"] > 0 and not any(s == "lexical" and c for (_, s), c in votes.items())
        table = {r.name: (r.origin, r.version, r.weight) for r in detectors.provenance(spark).collect()}
        assert table["volume"] == ("registered", "3", 0.5) and table["lexical"] == ("registered", "1", 0.25) and table["dga"][0] == "built in"
        assert "volume" not in detectors.weights(spark.newSession())
    finally:
        for n in ("volume", "lexical"):
            detectors.unregister(spark, n)
    assert {r.raw: r.assessment.raw_score for r in analysis.analyze(raw).collect()} == before
    for bad in (detectors.Detector("other", loud), detectors.Detector("assessment", loud, 1.0), detectors.Detector("no name", loud, 1.0)):
        with pytest.raises(ValueError):
            detectors.register(spark, bad)


def test_files_of_three_ages(spark, tmp_path):
    path = str(tmp_path / "ages")
    spark.sql("select 1 as a, 'x' as b").write.parquet(f"{path}/0")
    spark.sql("select 2L as a, 'y' as b, 1.5f as c").write.parquet(f"{path}/1")
    spark.sql("select 3L as a, 2.5d as c, true as old").write.parquet(f"{path}/2")
    schema = "a bigint, b string, c double, d array<int>"
    rows = schema_history.read_evolved(spark, path, schema).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, "x", None, None), (2, "y", 1.5, None), (3, None, 2.5, None)]
    got = {(r.column, r.kind, r.stored, r.wanted, r.files) for r in schema_history.differences(spark, path, schema).collect()}
    assert got == {("a", "widened", "int", "bigint", 1), ("b", "missing", None, "string", 1), ("c", "missing", None, "double", 1), ("c", "widened", "float", "double", 1), ("d", "missing", None, "array<int>", 3), ("old", "extra", "boolean", None, 1)}
    with pytest.raises(ValueError, match="a bigint as int, b string as bigint"):
        schema_history.read_evolved(spark, path, "a int, b bigint")


def test_the_store_s_own_files_have_its_schema(spark, tmp_path):
    path = str(tmp_path / "events")
    event_store.append(spark.sql("select 'a.test' as domain, 5 as risk_score"), path, 0)
    assert schema_history.differences(spark, path, event_store.SCHEMA).count() == 0
    shown = event_store.projected(event_store.read(spark, path))
    assert shown.first().asDict() | {"id": 0} == {
        **dict.fromkeys(shown.columns), "id": 0, "domain": "a.test", "risk_score": 5, "threat_categories": [], "top_factors": [], "overrides_applied": [], "event_type": "analysis", "blocked": False, "upstream_used": False, "cache_hit": False,
    }
