"""Corrupted triples: samplers, and filters that keep known triples out of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import positions
from .splitting import basic_negatives, unit_hash


def pseudo_typed(triples: DataFrame, per_positive: int = 1, seed: int = 0) -> DataFrame:
    """Corrupted copies (h, r, t, corrupted_head, positive_h, positive_t) whose new head or tail is another head or tail of the same relation.

    A hash draws from the relation's heads and tails together and decides so which side it replaces; a draw of the positive itself
    moves on to the next of its pool. Relations of one head and one tail have no such copy and none is returned. Pools are numbered by ranges, so
    a relation that holds most triples is no single task's. Repeated triples have the same copies; null ends are never drawn.
    """
    ends = F.explode(F.array(F.struct(F.lit(True).alias("on_head"), F.col("h").alias("e")), F.struct(F.lit(False).alias("on_head"), F.col("t").alias("e"))))
    pool = triples.select("r", ends.alias("x")).select("r", "x.on_head", "x.e").where("e is not null").distinct()
    placed = positions(pool, ["r", "on_head"], ["e"])
    sizes = pool.groupBy("r").agg(F.sum(F.col("on_head").cast("long")).alias("heads"), F.sum((~F.col("on_head")).cast("long")).alias("tails"))
    asked = triples.select("h", "r", "t").join(sizes, "r").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_positive - 1))))
    # the positive's own place is left out of the range that is drawn from
    u = unit_hash("h", "r", "t", "k", seed=seed)
    asked = asked.withColumn("draw", F.floor(u * (F.col("heads") + F.col("tails") - 2)).cast("long")).where("heads + tails > 2")
    asked = asked.withColumn("on_head", F.col("draw") < F.col("heads") - 1).withColumn("place", F.when(F.col("on_head"), F.col("draw")).otherwise(F.col("draw") - F.col("heads") + 1))
    own = placed.select(F.col("r").alias("r0"), F.col("on_head").alias("side0"), F.col("e").alias("e0"), F.col("place").alias("own"))
    mine = F.when(F.col("on_head"), F.col("h")).otherwise(F.col("t"))
    asked = asked.join(own, (F.col("r") == F.col("r0")) & (F.col("on_head") == F.col("side0")) & (mine == F.col("e0")))
    asked = asked.withColumn("place", F.col("place") + (F.col("place") >= F.col("own")).cast("long"))
    found = asked.join(placed, ["r", "on_head", "place"])
    return found.select(F.when(F.col("on_head"), F.col("e")).otherwise(F.col("h")).alias("h"), "r", F.when(F.col("on_head"), F.col("t")).otherwise(F.col("e")).alias("t"), F.col("on_head").alias("corrupted_head"), F.col("h").alias("positive_h"), F.col("t").alias("positive_t"))


def pseudo_typed_tails(triples: DataFrame, seed: int = 0) -> DataFrame:
    """(h, r, t, negative): each triple with another tail of its relation, at a hashed place in the relation's pool that isn't its own tail's. Relations of one tail have none."""
    pool = triples.select("r", F.col("t").alias("negative")).where("negative is not null").distinct()
    placed = positions(pool, ["r"], ["negative"])
    asked = triples.select("h", "r", "t").join(pool.groupBy("r").agg(F.count("*").alias("n")), "r").where("n > 1")
    asked = asked.join(placed.select("r", F.col("negative").alias("t"), F.col("place").alias("own")), ["r", "t"])
    draw = F.floor(unit_hash("h", "r", "t", seed=seed) * (F.col("n") - 1)).cast("long")
    asked = asked.withColumn("draw", draw).withColumn("place", F.col("draw") + (F.col("draw") >= F.col("own")).cast("long"))
    return asked.join(placed, ["r", "place"]).select("h", "r", "t", "negative")


def filtered(negatives: DataFrame, known: DataFrame) -> DataFrame:
    """The negatives that are no known triples."""
    return negatives.join(known.select("h", "r", "t").distinct(), ["h", "r", "t"], "left_anti")


class BloomFilter:
    """A set of triples as bits of a fixed number, which lets every member pass and some others.

    ``error``: share of others that pass; the bits are made for ``expected`` triples and set by aggregation, so the driver gets a
    bit set and never the triples.
    """

    def __init__(self, triples: DataFrame, expected: int, error: float = 0.001):
        n = max(64, int(-expected * np.log(error) / np.log(2) ** 2))
        self.bits, self.hashes = -(-n // 64) * 64, max(1, round(n / max(1, expected) * np.log(2)))
        if self.bits > 1 << 31:
            raise ValueError("more than 256 MB of bits")
        at = F.explode(F.array(*self._places()))
        word = triples.where("h is not null and r is not null and t is not null").select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int")).alias("bit"))
        found = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.words = np.zeros(self.bits // 64, np.uint64)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def _places(self) -> list[Column]:
        a, b = F.xxhash64("h", "r", "t"), F.xxhash64(F.lit(1), "h", "r", "t")
        odd = b.bitwiseOR(F.lit(1))
        # additions wrap in a decimal's remainder: ANSI longs would overflow
        return [F.pmod(F.pmod(a, F.lit(self.bits)) + k * F.pmod(odd, F.lit(self.bits)), F.lit(self.bits)) for k in range(self.hashes)]

    def without_members(self, rows: DataFrame) -> DataFrame:
        """The rows (h, r, t and any other columns) that aren't in the set, without the few that it takes for members."""
        shared = rows.sparkSession.sparkContext.broadcast(self.words)
        kept = rows.columns
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = shared.value
            for batch in batches:
                inside = np.ones(batch.num_rows, bool)
                for k in range(batch.num_columns - len(kept)):
                    at = batch.column(len(kept) + k).to_numpy(zero_copy_only=False)
                    inside &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(~inside)) for i in range(len(kept))], names=kept)

        return rows.select("*", *(p.alias(f"_place_{k}") for k, p in enumerate(self._places()))).mapInArrow(run, types)


#: Samplers by name: from id triples and the number of entities.
SAMPLERS = {
    "basic": lambda triples, n, k=1, seed=0: basic_negatives(triples, n, k, seed),
    "pseudo_typed": lambda triples, n, k=1, seed=0: pseudo_typed(triples, k, seed),
}
