from tessarine.operators import classification


def test_rates_without_cases_are_null(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 1)], "score double, y int")
    got = classification.rates(rows, 0.0).first()
    assert got.false_positive_rate is None and got.false_negative_rate == 0 and got.prevalence == 1
    assert classification.confusion(rows, 0.0).first().specificity is None
    assert classification.roc_auc(rows).first().roc_auc is None
    assert classification.rates(rows.where("false"), 0.0).first().prevalence is None


def test_auc_with_ties(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.3, 0), (0.1, 1)]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z]
    got = classification.roc_auc(spark.createDataFrame(rows, "score double, y int")).first()
    assert abs(got.roc_auc - sum(pairs) / len(pairs)) < 1e-12
