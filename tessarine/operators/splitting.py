"""Splits of triples by hashes (so reruns agree), inductive splits, cleaners, and negative samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encode import dense_ids
from ..sources.staging import staged


def unit_hash(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) from a row's columns and a seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def normalized(ratios: list[float]) -> list[float]:
    """The ratios with what is left to one appended; more than one is an error."""
    total = sum(ratios)
    if total > 1 + 1e-6 or any(r < 0 for r in ratios):
        raise ValueError("ratios must be at least 0 and add up to at most 1")
    return [*ratios, 1 - total] if total < 1 - 1e-6 else list(ratios)


def sizes(n: int, ratios: list[float]) -> list[int]:
    """Whole sizes that add up to n: differences of the floors of the running sums."""
    running, out, before = 0.0, [], 0
    for k, r in enumerate(ratios):
        running += r
        now = n if k == len(ratios) - 1 else int(running * n + 1e-9)
        out.append(now - before)
        before = now
    return out


def split(triples: DataFrame, ratios: list[float], seed: int = 0) -> DataFrame:
    """Distinct triples with a column part: exact sizes in the order of a seeded hash, ids assigned by ranges."""
    keyed = triples.select(F.struct(unit_hash("h", "r", "t", seed=seed).alias("u"), "h", "r", "t").alias("key"))
    placed = staged(dense_ids(keyed, "key", "at"))
    cut = [0]
    for s in sizes(placed.count(), normalized(ratios)):
        cut.append(cut[-1] + s)
    part = F.lit(len(cut) - 2)
    for k in range(len(cut) - 3, -1, -1):
        part = F.when(F.col("at") < cut[k + 1], k).otherwise(part)
    return placed.select("key.h", "key.r", "key.t", part.alias("part"))


def cover(triples: DataFrame) -> DataFrame:
    """Triples that together name every relation and entity: the least triple of each relation, head and tail."""
    least = lambda key: triples.groupBy(key).agg(F.min(F.struct("h", "r", "t")).alias("x")).select("x.h", "x.r", "x.t")
    return least("r").unionByName(least("h")).unionByName(least("t")).distinct()


def coverage_split(triples: DataFrame, ratios: list[float], seed: int = 0) -> DataFrame:
    """A split whose part 0 holds a cover, so that no entity or relation is unseen; part 0 has at least its share."""
    held = cover(triples)
    rest = triples.select("h", "r", "t").join(held, ["h", "r", "t"], "left_anti")
    n, m = triples.select("h", "r", "t").distinct().count(), held.count()
    want = sizes(n, normalized(ratios))
    if m > want[0]:
        raise ValueError(f"the cover has {m} triples, part 0 only {want[0]}")
    left = [want[0] - m, *want[1:]]
    return split(rest, [x / max(1, n - m) for x in left], seed).unionByName(held.withColumn("part", F.lit(0)))


def cleaned(training: DataFrame, testing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every testing triple with an entity or relation that training lacks moves to training."""
    entities = training.select(F.explode(F.array("h", "t")).alias("e")).distinct()
    good = testing.join(entities.withColumnRenamed("e", "h"), "h", "left_semi").join(entities.withColumnRenamed("e", "t"), "t", "left_semi").join(training.select("r").distinct(), "r", "left_semi").select("h", "r", "t")
    moved = testing.select("h", "r", "t").join(good, ["h", "r", "t"], "left_anti")
    return training.select("h", "r", "t").unionByName(moved), good


def entity_part(c: str, ratios: list[float], seed: int) -> Column:
    """The part that an entity's hash falls into."""
    u, part, bound = unit_hash(c, seed=seed), F.lit(len(ratios) - 1), sum(ratios[:-1])
    for k in range(len(ratios) - 2, -1, -1):
        part = F.when(u < bound, k).otherwise(part)
        bound -= ratios[k]
    return part


def semi_inductive(triples: DataFrame, ratios: list[float], seed: int = 0) -> DataFrame:
    """Entities are split; part 0 has triples with both ends in it, part i those with one end in 0 and one in i. Others go."""
    r = normalized(ratios)
    a, b = entity_part("h", r, seed), entity_part("t", r, seed)
    return triples.withColumn("a", a).withColumn("b", b).where(F.least("a", "b") == 0).select("h", "r", "t", F.greatest("a", "b").alias("part"))


def fully_inductive(triples: DataFrame, train_share: float = 0.5, seed: int = 0, evaluation: list[float] | None = None) -> DataFrame:
    """Triples within one of two disjoint sets of entities: part 0 trains, part 1 is the inference graph.

    With ``evaluation`` ratios the inference graph's triples are split further, into parts 1, 2 and so on of exact sizes. Triples between the sets go.
    """
    r = [train_share, 1 - train_share]
    found = triples.withColumn("part", entity_part("h", r, seed)).where(F.col("part") == entity_part("t", r, seed)).select("h", "r", "t", "part")
    if evaluation is None:
        return found
    found = staged(found)
    inference = split(found.where("part = 1"), evaluation, seed + 1)
    return found.where("part = 0").select("h", "r", "t", F.lit(0).alias("part")).unionByName(inference.withColumn("part", (F.col("part") + 1).cast("int")))


def cleaned_at_random(training: DataFrame, testing: DataFrame, seed: int = 0, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Testing triples move to training until no entity or relation of testing is unseen; fewer than ``cleaned`` moves.

    Of the testing triples that name an unseen entity or relation, a round moves the one that a hash puts first, for each of them; what these
    bring along is seen from then on. More than ``most`` rounds raise RuntimeError.
    """
    training, testing = staged(training.select("h", "r", "t")), staged(testing.select("h", "r", "t").distinct())
    for k in range(most):
        seen = training.select(F.explode(F.array("h", "t")).alias("e")).distinct()
        names = F.explode(F.array(F.struct(F.lit("e").alias("kind"), F.col("h").alias("name")), F.struct(F.lit("e").alias("kind"), F.col("t").alias("name")), F.struct(F.lit("r").alias("kind"), F.col("r").alias("name"))))
        known = seen.select(F.lit("e").alias("kind"), F.col("e").cast("string").alias("name")).unionByName(training.select(F.lit("r").alias("kind"), F.col("r").cast("string").alias("name")).distinct())
        each = testing.select("h", "r", "t", names.alias("x")).select("h", "r", "t", "x.kind", F.col("x.name").cast("string").alias("name"))
        unseen = each.join(known, ["kind", "name"], "left_anti")
        moved = staged(unseen.groupBy("kind", "name").agg(F.min(F.struct(unit_hash("h", "r", "t", seed=seed + k).alias("u"), "h", "r", "t")).alias("x")).select("x.h", "x.r", "x.t").distinct())
        if moved.isEmpty():
            return training, testing
        training, testing = staged(training.unionByName(moved)), staged(testing.join(moved, ["h", "r", "t"], "left_anti"))
    raise RuntimeError(f"not clean after {most} rounds")


def parted(triples: DataFrame, ratios: list[float], method: str = "coverage", seed: int = 0) -> DataFrame:
    """A split by name: random (exact sizes alone), coverage (part 0 covers all entities and relations), cleanup and random_cleanup (what part 0 lacks moves to it)."""
    if method == "coverage":
        return coverage_split(triples, ratios, seed)
    whole = split(triples, ratios, seed)
    if method == "random":
        return whole
    if method not in ("cleanup", "random_cleanup"):
        raise ValueError(f"no split {method}")
    whole = staged(whole)
    one = lambda k: whole.where(F.col("part") == k).select("h", "r", "t")
    training, out = one(0), None
    for k in range(1, len(normalized(ratios))):
        training, rest = cleaned(training, one(k)) if method == "cleanup" else cleaned_at_random(training, one(k), seed)
        rest = rest.withColumn("part", F.lit(k))
        out = rest if out is None else out.unionByName(rest)
    training = training.withColumn("part", F.lit(0))
    return training if out is None else training.unionByName(out)


def remixed(parts: DataFrame, seed: int = 0) -> DataFrame:
    """All triples of a split (h, r, t, part) dealt anew into parts of the same sizes."""
    sizes_ = {r.part: r.n for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes_.values())
    ratios = [sizes_[k] / n for k in sorted(sizes_)]
    found = split(parts.select("h", "r", "t"), ratios if len(ratios) > 1 else [1.0], seed)
    names = F.array(*(F.lit(k) for k in sorted(sizes_)))
    return found.select("h", "r", "t", F.get(names, F.col("part")).alias("part"))


def deteriorated(parts: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A share of part 0 moved to the other parts, in equal chunks by a hash; what doesn't divide stays with the first of them."""
    others = sorted(r.part for r in parts.select("part").distinct().collect() if r.part != 0)
    if not others or not 0 <= share <= 1:
        raise ValueError("a share between 0 and 1, and another part to move triples to")
    moving = split(parts.where("part = 0").select("h", "r", "t"), [1 - share, share], seed) if 0 < share < 1 else parts.where("part = 0").select("h", "r", "t", F.lit(0 if share == 0 else 1).alias("part"))
    to = F.get(F.array(*(F.lit(k) for k in others)), F.floor(unit_hash("h", "r", "t", seed=seed + 1) * len(others)).cast("int"))
    moved = moving.select("h", "r", "t", F.when(F.col("part") == 0, F.lit(0)).otherwise(to).alias("part"))
    return parts.where("part <> 0").select("h", "r", "t", "part").unionByName(moved)


def split_values(ids: DataFrame, column: str, ratios: list[float], seed: int = 0) -> DataFrame:
    """The distinct values of a column with a part each, of exact sizes in the order of a hash."""
    keyed = ids.select(F.col(column).alias("value")).where("value is not null").distinct()
    placed = staged(dense_ids(keyed.select(F.struct(unit_hash("value", seed=seed).alias("u"), "value").alias("key")), "key", "at"))
    ends, at = [], 0
    for n in sizes(placed.count(), normalized(ratios)):
        at += n
        ends.append(at)
    part = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        part = F.when(F.col("at") < ends[k], k).otherwise(part)
    return placed.select(F.col("key.value").alias(column), part.alias("part"))


def mini_batches(triples: DataFrame, size: int, epoch: int = 0, drop_last: bool = True) -> DataFrame:
    """Distinct triples with the number of their batch of an epoch; the last batch goes if it isn't full."""
    keyed = triples.select(F.struct(unit_hash("h", "r", "t", seed=epoch).alias("u"), "h", "r", "t").alias("key"))
    placed = staged(dense_ids(keyed, "key", "at"))
    out = placed.select("key.h", "key.r", "key.t", F.floor(F.col("at") / size).alias("batch"))
    return out.where(F.col("batch") < placed.count() // size) if drop_last else out


def generated(spark, num_entities: int, num_relations: int, num_triples: int, seed: int = 0) -> DataFrame:
    """Distinct random id triples that name every entity and relation; raises ValueError where that takes more triples."""
    if num_triples < max(num_entities, num_relations) or num_triples > num_entities * num_entities * num_relations:
        raise ValueError("as many triples as entities and relations at least, and no more than there are")
    draw = lambda n, k: F.floor(unit_hash("id", seed=seed * 7 + k) * n).cast("long")
    # the first triples name all in turn; the rest are drawn, with some to spare for repeats
    first = spark.range(max(num_entities, num_relations)).select((F.col("id") % num_entities).alias("h"), (F.col("id") % num_relations).alias("r"), draw(num_entities, 1).alias("t"))
    first = first.distinct()
    rest = spark.range(num_triples * 3 + 100).select(draw(num_entities, 2).alias("h"), draw(num_relations, 3).alias("r"), draw(num_entities, 4).alias("t")).distinct().join(first, ["h", "r", "t"], "left_anti")
    every = first.withColumn("u", F.lit(-1.0)).unionByName(rest.withColumn("u", unit_hash("h", "r", "t", seed=seed)))
    return every.orderBy("u", "h", "r", "t").limit(num_triples).select("h", "r", "t")


def basic_negatives(ids: DataFrame, num_entities: int, per_positive: int = 1, seed: int = 0, head_probability: Column | None = None) -> DataFrame:
    """Corrupted copies of id triples: head or tail (even odds, or by ``head_probability``) becomes another uniform id. A single entity has no other and gives none."""
    if num_entities < 2:
        ids = ids.limit(0)
    each = ids.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_positive - 1))))
    head = unit_hash("h", "r", "t", "k", seed=seed) < (head_probability if head_probability is not None else F.lit(0.5))
    other = lambda c: (F.col(c) + 1 + F.floor(unit_hash("h", "r", "t", "k", seed=seed + 1) * max(1, num_entities - 1))) % num_entities
    return each.select(F.when(head, other("h")).otherwise(F.col("h")).alias("h"), "r", F.when(head, F.col("t")).otherwise(other("t")).alias("t"), head.alias("corrupted_head"), F.col("h").alias("positive_h"), F.col("t").alias("positive_t"))
