from tessarine.operators import encode, relational, ranking
from tessarine.sources import graph_tables
from pyspark.sql import functions as F

PEOPLE = [("peter", "likes", "chocolate_cake"), ("chocolate_cake", "isA", "dish"), ("susan", "likes", "pizza"), ("peter", "likes", "susan")]


def test_files_keep_labels(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("nan\tr\ta\nb\tr\tnan\n\"q\tr\tb\nshort\trow\n")
    got = {tuple(r) for r in graph_tables.read_triples(spark, str(path)).collect()}
    assert got == {("nan", "r", "a"), ("b", "r", "nan"), ('"q', "r", "b")}
    swapped = graph_tables.read_triples(spark, str(path), columns=(0, 2, 1))
    assert ("nan", "a", "r") in {tuple(r) for r in swapped.collect()}
    graph_tables.write_triples(spark.createDataFrame(PEOPLE, "h string, r string, t string"), str(tmp_path / "out"))
    assert {tuple(r) for r in graph_tables.read_triples(spark, str(tmp_path / "out")).collect()} == set(PEOPLE)


def test_dataset_round_trip(spark, tmp_path):
    kg = spark.createDataFrame(PEOPLE, "h string, r string, t string")
    graph_tables.write_dataset({"training": kg.limit(3), "testing": kg.where("r = 'isA'")}, str(tmp_path / "d"))
    back = graph_tables.read_dataset(spark, str(tmp_path / "d"))
    assert back["training"].count() == 3 and [tuple(r) for r in back["testing"].collect()] == [PEOPLE[1]]


def test_dictionaries_and_instances(spark):
    kg = spark.createDataFrame([*PEOPLE, ("a", "likes_inverse", "b")], "h string, r string, t string")
    assert [r.label for r in encode.relation_dictionary(kg).orderBy("id").collect()] == ["isA", "likes", "likes_inverse"]
    ids = encode.encode(spark.createDataFrame([*PEOPLE, PEOPLE[0]], "h string, r string, t string"), encode.entity_dictionary(kg), encode.relation_dictionary(kg))
    assert ids.count() == 4
    got = encode.decode(ids.union(spark.createDataFrame([(99, 0, 0)], ids.schema)), encode.entity_dictionary(kg), encode.relation_dictionary(kg))
    assert {r.h_label for r in got.where("h = 99").collect()} == {"[UNKNOWN]"}
    assert {(r.h, tuple(r.targets)) for r in relational.training_instances(kg).where("r = 'likes'").collect()} == {("peter", ("chocolate_cake", "susan")), ("susan", ("pizza",))}


def test_ranks_with_ties_and_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 0.0, 1.0], 1.0), ([1.0, 1.0, 3.0, nan, 0.0], 1.0)], "scores array<double>, true double")
    got = [r.x for r in df.select(ranking.ranks_from_scores().alias("x")).collect()]
    assert [(x.optimistic, x.pessimistic, x.realistic, x.options) for x in got] == [(3, 4, 3.5, 5), (2, 3, 2.5, 4)]
