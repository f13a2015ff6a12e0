"""Digests, shared folders and streams."""

import shutil

import pytest

from tabloom import session
from tabloom.sources import versions as W
from tabloom.streaming.score import score_available


def test_digest_tells_contents_apart(spark):
    def digest(rows, schema="a string, b string"):
        return W.dataset_hash(spark.createDataFrame(rows, schema)).first().digest

    assert digest([("a|b", "c")]) != digest([("a", "b|c")])
    assert digest([(None, "c")]) != digest([("<null>", "c")]) != digest([("-", "c")])
    assert digest([(1e-7,)], "a double") != digest([(2e-7,)], "a double")
    assert digest([(1e33,)], "a double") == digest([(1e33,)], "a double")
    assert digest([("x", "y"), ("p", None)]) == digest([("p", None), ("x", "y")])
    assert digest([("1", "x")]) != digest([("1", "x")], "k string, z string") != digest([(1, "x")], "k bigint, z string")
    assert digest([({"a": 1, "b": 2},)], "m map<string,int>") == digest([({"b": 2, "a": 1},)], "m map<string,int>")
    assert digest([(None,)], "m array<int>") != digest([([],)], "m array<int>")


def test_digest_does_not_depend_on_the_time_zone(spark):
    df = spark.range(5).selectExpr("id", "timestamp_seconds(id * 100000) AS at", "array(timestamp_seconds(id)) AS more")
    seen = set()
    for zone in ("UTC", "America/New_York", "Asia/Kathmandu"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        seen.add(W.dataset_hash(df).first().digest)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(seen) == 1


def test_stream_scores_only_what_came_since(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.range(5).write.parquet(str(tmp_path / "first"))
    spark.range(5, 8).write.parquet(str(tmp_path / "second"))
    source.mkdir()
    for name, want in (("first", 5), ("second", 8)):
        for part in (tmp_path / name).glob("*.parquet"):
            shutil.copy(part, source / f"{name}-{part.name}")
        got = score_available(spark, str(source), "*.parquet", [lambda df: df.withColumnRenamed("id", "k")], out)
        assert sorted(r.k for r in got.collect()) == list(range(want))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Session())
