"""Queries without SQL do the whole of their job, whatever the ids."""

from pyspark.sql import functions as F
from roundline import registry
from roundline.operators import boosting, verify
from roundline.plans import evaluation
from roundline.sources import files


def test_views_cover_their_tables(spark, data):
    """Every order is a truth and a detection, and recordings grow with the tables."""
    from roundline.sources import adapters as A

    n = spark.read.parquet(f"{data}/orders.parquet").count()
    assert A.truths(spark, data).count() == A.detections(spark, data).count() == n
    stems = lambda sf: A.hud_reads(spark, sf).select("stem").distinct().count()
    assert stems("/root/testdata/sf0.01") > 5 * stems(data)


def test_own_cluster_takes_names_of_any_order(spark, monkeypatch):
    rows = spark.createDataFrame([("s", i, "alpha", 2.5, 0.9) for i in range(1000, 1005)], "stem string, ord long, text string, weight double, conf double")
    monkeypatch.setattr(evaluation.A, "votes", lambda spark, sf_dir: rows)
    assert [r.stem for r in evaluation.own_cluster(spark, "").select("stem", F.lit(1)).collect()] == ["s"]


def test_trees_have_fifty_iterations():
    assert boosting.ROUNDS == 50


def test_each_group_is_left_out_alone(spark):
    """Every score comes from a model of all other groups, the one without a name among them."""
    rows = spark.createDataFrame([(g, 10 * j + i, i % 2, float(i + 7 * j)) for j, g in enumerate(("a", "b", "c", "d", "e", None)) for i in range(4)], "stem string, seg int, label int, x double")
    numbers, counts = verify._groups(rows, "stem")
    assert sorted(numbers.values()) == [1, 2, 3, 4, 5, 6] and counts.tolist() == [[12, 12]] + [[10, 10]] * 6
    for kind, sizes in (("logistic", {}), ("trees", {"rounds": 1})):
        _, out = verify.left_out(files.written(rows, "six"), ["x"], kind, files.scratch(spark, "six"), **sizes)
        assert out.count() == 24
