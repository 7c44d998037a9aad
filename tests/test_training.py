from pyspark.sql import functions as F

from tessarine.operators import training


def test_loss_falls_and_known_tails_score_above_others(spark):
    n = 40
    rows = [(i, 0, (i * 7) % 5 + 40) for i in range(n)] + [(i, 1, 45 + i % 3) for i in range(n)]
    ids = spark.createDataFrame(rows, "h long, r long, t long")
    entities, relations, losses = training.train(ids, 48, dim=8, epochs=6, rate=4.0)
    assert losses[-1] < losses[0] and entities.count() == 48 and relations.count() == 2
    scores = training.scored(ids, entities, relations).agg(F.avg("score")).first()[0]
    others = training.scored(ids.withColumn("t", (F.col("t") + 17) % 40), entities, relations).agg(F.avg("score")).first()[0]
    assert scores > others
    found = training.predictions(ids.where("r = 1"), entities, relations, ids, 3).collect()
    assert len(found) == 3 * n and not {(x.h, x.r, x.t) for x in found} & set(rows)
