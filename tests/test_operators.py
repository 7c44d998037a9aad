from tessarine.operators import alignment, analysis, encode, graph, ranking, relational, splitting
from tessarine.operators.components import connected_components

SCHEMA = "h string, r string, t string"


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for make in (analysis.functionality, analysis.cardinality_types, analysis.symmetry, analysis.composition, analysis.bernoulli, encode.entity_dictionary, graph.relation_tokens, graph.pagerank, splitting.cover, ranking.marginal_scores):
        assert make(none).count() == 0
    assert connected_components(none, "h", "t").count() == 0
    assert relational.steps(none, none).first().similarity is None
    assert splitting.split(none, [0.8]).count() == 0
    assert graph.distances(none, none.selectExpr("h as node"), 2).count() == 0


def test_components_of_chains_loops_and_nulls(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, 100), (None, 5), (201, 200), (200, 201), (7, 3)]
    got = {r["node"]: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 200, 201: 200}


def test_ratios():
    assert splitting.normalized([0.8, 0.1])[2] > 0.09 and splitting.normalized([0.5, 0.5]) == [0.5, 0.5]
    assert splitting.sizes(7, [0.5, 0.25, 0.25]) == [3, 2, 2] and sum(splitting.sizes(101, [0.8, 0.1, 0.1])) == 101


def test_cleaner_moves_what_training_lacks(spark):
    training = spark.createDataFrame([("a", "r", "b")], SCHEMA)
    testing = spark.createDataFrame([("b", "r", "a"), ("a", "r", "z"), ("a", "s", "b")], SCHEMA)
    left, right = splitting.cleaned(training, testing)
    assert {tuple(x) for x in right.collect()} == {("b", "r", "a")} and left.count() == 3


def test_collapse_merges_aligned_chains(spark):
    left = spark.createDataFrame([("a", "r", "b")], SCHEMA)
    right = spark.createDataFrame([("x", "r", "y")], SCHEMA)
    pairs = spark.createDataFrame([("a", "x"), ("b", "x")], "left string, right string")
    got = {tuple(r) for r in alignment.collapse_union(left, right, pairs).collect()}
    assert got == {("left:a", "left:r", "left:a"), ("left:a", "right:r", "right:y")}
    assert alignment.same_as_union(left, right, pairs).count() == 4
