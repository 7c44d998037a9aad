"""Nulls, repeated rows, ties and empty tables of the graph operators, as their modules state."""

import pytest
from pyspark.sql import functions as F

from tessarine.operators import alignment, analysis, classification, encode, graph, ranking, relational
from tessarine.operators.components import connected_components

SCHEMA = "h string, r string, t string"


def odd(spark):
    return spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("b", "r", "a"), (None, "r", "a"), ("a", None, "b"), ("a", "s", None), ("c", "s", "c")], SCHEMA)


EMPTY = [
    analysis.relation_counts, analysis.entity_counts, analysis.functionality, analysis.injectivity, analysis.cardinality_types, analysis.symmetry, analysis.inversion, analysis.composition, analysis.pattern_types,
    analysis.jaccard, analysis.leaking_relations, analysis.bernoulli, analysis.pseudo_types, analysis.inverse_frequency, analysis.pair_weights, graph.degrees, graph.neighbours, graph.edge_weights, graph.relation_tokens,
    graph.walk_returns_by_triangles, graph.colours, graph.pagerank, ranking.marginal_scores, ranking.soft_inverse_scores, relational.known_targets, relational.training_instances, encode.entity_dictionary, encode.relation_dictionary,
    lambda kg: connected_components(kg, "h", "t"), lambda kg: relational.without_known(kg, kg), lambda kg: graph.rank_anchors(kg, 3), lambda kg: graph.sampled_tokens(kg, 2),
]


@pytest.mark.parametrize("operator", EMPTY)
def test_empty_tables_and_odd_rows(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
    operator(odd(spark)).collect()


def test_repeats_and_nulls_count_as_stated(spark):
    kg = odd(spark)
    assert {r.r: r["count"] for r in analysis.relation_counts(kg).collect()} == {"r": 4, None: 1, "s": 2}
    assert {(r.r, r.pattern): r.confidence for r in analysis.symmetry(kg.where("r = 'r' and h is not null")).collect()}["r", "symmetry"] == 1
    assert {r.node: r.degree for r in graph.degrees(kg.where("h is not null and t is not null")).collect()} == {"a": 4, "b": 4, "c": 2}
    assert {tuple(r) for r in graph.neighbours(kg).collect()} == {("a", "b"), ("b", "a")}
    assert relational.restrict(kg, entities=spark.createDataFrame([("a",), ("b",)], "label string")).count() == 4
    assert relational.without_known(kg, kg).count() == 3
    ids = encode.encode(kg, encode.entity_dictionary(kg), encode.relation_dictionary(kg))
    assert ids.count() == 3
    assert relational.steps(kg.where("false"), kg).first().similarity is None
    pairs = spark.createDataFrame([("a", "a"), ("a", "a"), (None, "b")], "left string, right string")
    whole = kg.where("h is not null and r is not null and t is not null")
    assert alignment.same_as_union(whole, whole, pairs.where("left is not null")).where("r = 'same-as'").count() == 1


def test_undefined_metrics_are_null(spark):
    rows = spark.createDataFrame([("tail", "realistic", 1.0, 1), ("tail", "realistic", None, 5)], "side string, rank_type string, rank double, candidates long")
    got = {(r.side, r.metric): r.value for r in ranking.all_metrics(rows).collect()}
    assert got["tail", "count"] == 1 and got["both", "inverse_harmonic_mean_rank"] == 1
    assert got["tail", "adjusted_arithmetic_mean_rank_index"] is None and got["tail", "z_hits_at_1"] is None and got["tail", "adjusted_hits_at_10"] is None
    assert ranking.all_metrics(rows.where("false")).count() == 0
    weighted = rows.limit(1).unionByName(spark.createDataFrame([("tail", "realistic", 9.0, 10)], rows.schema)).withColumn("w", F.when(F.col("rank") == 1, 3.0).otherwise(1.0))
    got = {r.metric: r.value for r in ranking.all_metrics(weighted, weight="w").where("side = 'tail'").collect()}
    assert got["arithmetic_mean_rank"] == 3 and got["median_rank"] == 1 and got["hits_at_3"] == 0.75
    scores = spark.createDataFrame([(1.0, 1), (None, 1), (0.0, None)], "score double, y long")
    assert classification.confusion(scores, 0.5).first().tp == 1 and classification.roc_auc(scores).first().roc_auc is None


def test_medians_are_those_of_all_values(spark):
    rows = [("a", float(i * i % 17)) for i in range(50)] + [("b", 3.0)] + [("c", 1.0), ("c", 2.0)]
    got = {r.k: r.median for r in ranking.medians(spark.createDataFrame(rows, "k string, x double").repartition(6), ["k"], "x").collect()}
    every = sorted(x for k, x in rows if k == "a")
    assert got == {"a": (every[24] + every[25]) / 2, "b": 3.0, "c": 1.5}
