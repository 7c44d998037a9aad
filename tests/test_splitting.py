import pytest
from pyspark.sql import functions as F

from tessarine.operators import negatives, splitting
from tessarine.plans import catalog

SF = "/root/testdata/sf0.001"


def graph(spark, n=200):
    return spark.createDataFrame(sorted({(f"e{i * 7 % 40}", f"r{i % 4}", f"e{i * 11 % 53}") for i in range(n)}), "h string, r string, t string")


def test_methods_of_splits(spark):
    kg = graph(spark)
    n = kg.count()
    for method in ("random", "coverage", "cleanup", "random_cleanup"):
        rows = splitting.parted(kg, [0.7, 0.2], method, 3).collect()
        assert len(rows) == len({(r.h, r.r, r.t) for r in rows}) == n
        first = [r for r in rows if r.part == 0]
        seen = {x for r in first for x in (r.h, r.t)}, {r.r for r in first}
        if method != "random":
            assert all(r.h in seen[0] and r.t in seen[0] and r.r in seen[1] for r in rows)
    with pytest.raises(ValueError):
        splitting.parted(kg, [0.5], "none")


def test_random_cleaning_moves_fewer(spark):
    training = spark.createDataFrame([("a", "r", "b")], "h string, r string, t string")
    testing = spark.createDataFrame([("x", "r", "a"), ("x", "r", "b"), ("b", "r", "x"), ("a", "s", "b"), ("b", "s", "a"), ("a", "r", "b")], training.schema)
    left, right = splitting.cleaned_at_random(training, testing)
    assert left.count() == 3 and right.count() == 4
    assert splitting.cleaned(training, testing)[1].count() == 1


def test_remix_and_deteriorate(spark):
    parts = splitting.split(graph(spark), [0.6, 0.3])
    sizes = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    again = splitting.remixed(parts, 5)
    assert {r.part: r["count"] for r in again.groupBy("part").count().collect()} == sizes
    assert again.join(parts, ["h", "r", "t", "part"], "left_anti").count() > 0
    for share in (0, 0.5, 1):
        worse = splitting.deteriorated(parts, share)
        got = {r.part: r["count"] for r in worse.groupBy("part").count().collect()}
        assert worse.distinct().count() == sum(sizes.values()) and abs(got.get(0, 0) - (1 - share) * sizes[0]) <= 1
    with pytest.raises(ValueError):
        splitting.deteriorated(parts.where("part = 0"), 0.5)


def test_inductive_evaluation_parts(spark):
    rows = splitting.fully_inductive(graph(spark, 900), 0.5, 1, [0.5, 0.25]).collect()
    ends = lambda p: {x for r in rows if r.part in p for x in (r.h, r.t)}
    assert {r.part for r in rows} == {0, 1, 2, 3} and not ends({0}) & ends({1, 2, 3})


def test_batches_and_generated_triples(spark):
    kg = graph(spark)
    n = kg.count()
    batches = splitting.mini_batches(kg, 16, 2).groupBy("batch").count().collect()
    assert len(batches) == n // 16 and all(r["count"] == 16 for r in batches)
    assert splitting.mini_batches(kg, 16, drop_last=False).count() == n
    rows = splitting.generated(spark, 20, 5, 80, 1).collect()
    assert len({tuple(r) for r in rows}) == 80 and {r.r for r in rows} == set(range(5)) and {r.h for r in rows} == set(range(20))
    with pytest.raises(ValueError):
        splitting.generated(spark, 20, 5, 3)
    values = splitting.split_values(kg, "r", [0.5]).collect()
    assert sorted(r.part for r in values) == [0, 0, 1, 1]


def test_pseudo_typed_copies_and_hot_relations(spark):
    rows = [(f"h{i}", "hot", f"t{i % 50}") for i in range(500)] + [("a", "single", "b"), ("a", "double", "b"), ("c", "double", "b"), (None, "hot", "t1")]
    kg = spark.createDataFrame(rows, "h string, r string, t string")
    got = negatives.pseudo_typed(kg, 3).collect()
    assert not any(r.r == "single" for r in got)
    assert sum(r.r == "hot" for r in got) >= 1500 and {(r.h, r.corrupted_head) for r in got if r.r == "double"} == {("c", True), ("a", True)}
    assert negatives.pseudo_typed(kg.where("false")).count() == 0


def test_bloom_filter(spark):
    rows = [(i, i % 7, 3 * i) for i in range(5000)]
    kg = spark.createDataFrame(rows, "h long, r long, t long")
    bloom = negatives.BloomFilter(kg, 5000, 0.01)
    assert bloom.without_members(kg).count() == 0
    other = spark.range(20_000).select((-F.col("id") - 1).alias("h"), F.lit(1).cast("long").alias("r"), F.col("id").alias("t"), F.lit("x").alias("more"))
    left = bloom.without_members(other)
    assert left.columns == other.columns and 0.96 * 20_000 < left.count() <= 20_000
    assert negatives.BloomFilter(kg.where("false"), 1).without_members(other).count() == 20_000
    assert negatives.filtered(other.limit(3), other.limit(3).select("h", "r", "t")).count() <= 3
    assert splitting.basic_negatives(kg.limit(2), 1).count() == 0


def test_registered_negatives_are_of_their_relations_and_whole(spark):
    kg = {tuple(r) for r in catalog.star_triples(spark, SF).select("h", "r", "t").collect()}
    heads, tails = {(r, h) for h, r, _ in kg}, {(r, t) for _, r, t in kg}
    found = catalog.QUERIES["typed_negatives"](spark, SF).collect()
    # every positive has its copy, whose new end is one of the relation's and not the positive's
    assert len(found) == len(kg)
    for r in found:
        assert ((r.r, r.h) in heads and r.h != r.positive_h and r.t == r.positive_t) if r.corrupted_head else ((r.r, r.t) in tails and r.t != r.positive_t and r.h == r.positive_h)
    several = {r for r in {r for r, _ in tails} if sum(x == r for x, _ in tails) > 1}
    assert catalog.QUERIES["pseudo_typed_negatives"](spark, SF).count() == sum(r in several for _, r, _ in kg)
    assert not kg & {(r.h, r.r, r.t) for r in catalog.QUERIES["filtered_negatives"](spark, SF).collect()}


def test_parts_of_a_semi_inductive_split_have_one_end_inside(spark):
    semi = catalog.QUERIES["semi_inductive_split"](spark, SF).collect()
    inside = {x for r in semi if r.part == 0 for x in (r.h, r.t)}
    ends = [(r.part, (r.h in inside) + (r.t in inside)) for r in semi]
    # an end of part 0 may stand in no triple of that part
    assert all(n == 2 if part == 0 else n <= 1 for part, n in ends) and {p for p, _ in ends} == {0, 1, 2}
    assert any(part > 0 and n == 1 for part, n in ends)
