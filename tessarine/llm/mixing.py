"""Mixing sources to target weights.

Every source's words, document after document, are one stream that is packed into blocks of ``block`` words
(the last is shorter). A source's target is its share by weight of all words; none takes more than
``most`` times its size, and what that leaves is shared again by weight. A source gets as many slots of the
mix as its target has blocks. A pseudorandom permutation of all slots deals them to output shards of
``shard_slots`` slots: a shard's counts by source are a multinomial draw given that all shards together have
exactly the slots of each source (an unconditional draw would miss a small source's target by its standard
deviation). Slot k of a source takes block p(k mod blocks), where p is the source's own pseudorandom
permutation for pass k div blocks; slots and blocks are joined by that index.

The permutations are swap-or-not shuffles (Hoang, Morris, Rogaway, 2012) in 64-bit integer arithmetic, so
reruns agree and SQL can state them. Streams are ordered by buckets of a hash of doc_id, then doc_id, and
places in them are running totals over buckets and groups of buckets, so no source is ever one task's.

Null and empty texts have size 0 and take nothing; a null source is a source of its own, the last; null ids
come first in their bucket; repeated rows each have their own place, rows alike but for other columns in the order of
a hash of all. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .common import n_words, row_hash

BLOCK, SHARD_SLOTS, MOST, ROUNDS = 128, 1024, 3, 16
#: Documents in a bucket of a stream on average, and buckets in a group.
BUCKET_ROWS, GROUP = 400, 1000
#: The prime of the mixing arithmetic.
P = 2147483647


def mix_sql(x: str, r: str, seed: str) -> str:
    """A number below P from three non-negative numbers, in SQL that Spark and DuckDB read alike."""
    t = f"((({x}) % {P}) * 48271 + (({x}) >> 31) * 40692 + ({r}) * 69621 + ({seed}) * 7919 + 12345) % {P}"
    return f"((((({t}) * ({t})) % {P}) * 16807 + {t}) % {P})"


def constants_sql(r: str, n: str, seed: str) -> tuple[str, str, str]:
    """What round ``r`` of a shuffle of the numbers below ``n`` draws: its key below n, and the factor and summand of its coin."""
    key = f"(({mix_sql(r, '1', seed)} * {P} + {mix_sql(r, '2', seed)}) % ({n}))"
    return key, f"({mix_sql(r, '3', seed)} % {P - 1} + 1)", mix_sql(r, "4", seed)


def swap_sql(x: str, n: str, key: str, factor: str, summand: str) -> str:
    """One round of the swap-or-not shuffle: ``x`` or its partner, by a coin that both share."""
    partner = f"(({key} + {n} - {x}) % {n})"
    return f"CASE WHEN ((((greatest({x}, {partner}) % {P}) * {factor} + {summand}) % {P}) >> 12) % 2 = 1 THEN {partner} ELSE {x} END"


def rounds_of(n: str, seed: str, rounds: int = ROUNDS):
    """The constants of all rounds as an array, for ``permuted``."""
    key, factor, summand = constants_sql("r", n, seed)
    return F.expr(f"transform(sequence(0L, {rounds - 1}L), r -> named_struct('k', {key}, 'a', {factor}, 'b', {summand}))")


def permuted(x: str, n: str, constants: str):
    """``x`` under the pseudorandom permutation of the numbers below ``n`` with these constants."""
    return F.expr(f"aggregate({constants}, cast({x} as bigint), (acc, c) -> {swap_sql('acc', n, 'c.k', 'c.a', 'c.b')})")


def running_start(rows: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """``rows`` with ``start``: the sum of ``value`` over the rows of the same keys before, by bucket, then ``order``.

    ``bucket`` must be a column. Three levels of totals keep every window small.
    """
    totals = rows.groupBy(*keys, "bucket").agg(F.sum(value).alias("total")).withColumn("group", F.expr(f"bucket >> {GROUP.bit_length()}"))
    groups = totals.groupBy(*keys, "group").agg(F.sum("total").alias("group_total"))
    before = lambda c, w: (F.sum(c).over(w) - F.col(c))
    groups = groups.select(*keys, "group", before("group_total", Window.partitionBy(*keys).orderBy("group")).alias("group_start"))
    inner = totals.withColumn("bucket_start", before("total", Window.partitionBy(*keys, "group").orderBy("bucket")))
    starts = inner.join(groups, [*keys, "group"]).select(*keys, "bucket", (F.col("group_start") + F.col("bucket_start")).alias("first"))
    own = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("within", F.sum(value).over(own) - F.col(value))
    return placed.join(starts, [*keys, "bucket"]).withColumn("start", F.col("first") + F.col("within")).drop("first", "within")


def _few(sources: DataFrame, most: int = 10_000) -> DataFrame:
    """A table with a row for each source, to be broadcast if these are few."""
    return F.broadcast(sources) if sources.count() <= most else sources


def source_targets(rows: DataFrame, most: int = MOST) -> DataFrame:
    """One row a source: source, source_no, source_size, target. Sources by code point, null last, weigh 1, 2, 3, repeating."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = sources.select("source", "source_size", (number - 1).cast("long").alias("source_no"))
    sources = sources.withColumn("weight", F.col("source_no") % 3 + 1)
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    capped = F.lit(most) * (F.sum("source_size").over(by_room) - F.col("source_size"))
    sources = sources.select(
        "*", F.sum("source_size").over(everything).alias("total"), capped.alias("capped"),
        (F.sum("weight").over(everything) - F.sum("weight").over(by_room) + F.col("weight")).alias("open_weight"), F.row_number().over(by_room).alias("nth"),
    )
    # the first source, by room for its weight, whose share of what the sources before leave is within its limit
    fits = (F.col("weight") * (F.col("total") - F.col("capped")) <= F.lit(most) * F.col("source_size") * F.col("open_weight"))
    level = F.min(F.when(fits, F.struct("nth", (F.col("total") - F.col("capped")).alias("left"), "open_weight"))).over(everything)
    sources = sources.withColumn("level", level)
    share = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.open_weight").cast("double")
    target = F.when(F.col("nth") < F.col("level.nth"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(share)
    return sources.select("source", "source_no", "source_size", target.alias("target"))


def slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, per_row: int = 4096) -> DataFrame:
    """Every slot of the mix: source_no, block_no, pass_no, shard, place.

    ``per_row``: slots that one row of the generator's input unfolds to, which spreads a large source.
    """
    counts = targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)))
    counts = counts.withColumn("slots", F.floor(F.col("target") / F.col("source_size") * F.col("blocks") + 0.5))
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("offset", F.sum("slots").over(before) - F.col("slots")).withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))
    total = counts.agg(F.sum("slots")).first()[0] or 0
    chunks = counts.where("slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / per_row)))).repartition(int(total) // (8 * per_row) + 1, "source_no", "chunk")
    # a pass has a permutation of its own; the chunk's passes are a few, at most three
    passes = F.sequence(F.floor(F.col("chunk") * per_row / F.col("blocks")), F.floor((F.least((F.col("chunk") + 1) * per_row, F.col("slots")) - 1) / F.col("blocks")))
    chunks = chunks.withColumn("pass_no", F.explode(passes))
    chunks = chunks.withColumn("shard_rounds", rounds_of("all_slots", "0L")).withColumn("own_rounds", rounds_of("blocks", "source_no * 4 + pass_no + 1"))
    low, high = F.greatest(F.col("chunk") * per_row, F.col("pass_no") * F.col("blocks")), F.least((F.col("chunk") + 1) * per_row, F.col("slots"), (F.col("pass_no") + 1) * F.col("blocks"))
    each = chunks.withColumn("k", F.explode(F.sequence(low, high - 1))).withColumn("g", F.col("offset") + F.col("k"))
    place, own = permuted("g", "all_slots", "shard_rounds"), permuted("k % blocks", "blocks", "own_rounds")
    each = each.select("source_no", own.alias("block_no"), "pass_no", place.alias("at"))
    return each.select("source_no", "block_no", "pass_no", F.floor(F.col("at") / shard_slots).alias("shard"), (F.col("at") % shard_slots).alias("place"))


def shard_counts(all_slots: DataFrame) -> DataFrame:
    """The draw: how many slots each source has in each output shard."""
    return all_slots.groupBy("shard", "source_no").agg(F.count("*").alias("slots"))


def placed(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """The documents' rows (doc_id, text_key, source_no, size, start) and the sources."""
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")))
    targets = staged(source_targets(rows))
    buckets = max(1, -(-rows.count() // bucket_rows))
    bucket = F.expr(f"coalesce({mix_sql('doc_id & 9223372036854775807', '3', '5')} % {buckets}, 0)")
    named = rows.join(_few(targets.select("source", "source_no")), rows.source.eqNullSafe(targets.source))
    named = named.select("doc_id", "text_key", "source_no", "size", bucket.alias("bucket"))
    order = [F.col("doc_id").asc_nulls_first(), "size", "text_key"]
    return running_start(named, ["source_no"], order, "size").drop("bucket"), targets


def takings(rows: DataFrame, targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row for each document row and block of it: the row's columns, first and words (within the document), times, first_shard."""
    used = slots(targets, block, shard_slots).groupBy("source_no", "block_no").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"))
    parts = rows.where("size > 0").withColumn("block_no", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    low = F.greatest(F.col("start"), F.col("block_no") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block)
    parts = parts.withColumn("first", low - F.col("start")).withColumn("words", high - low)
    # the slots come from a small table by explosion, so their size would be guessed far too low: never broadcast them
    return parts.join(used.hint("merge"), ["source_no", "block_no"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Every row's doc_id, size, source_size, target, taken (words the mix takes of it) and first_shard (null if none)."""
    rows, targets = placed(docs)
    rows = staged(rows)
    taken = takings(rows, targets, block, shard_slots).groupBy("doc_id", "source_no", "start", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("first_shard").alias("first_shard"))
    none = rows.where("size = 0").select("doc_id", "source_no", "start", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    found = taken.unionByName(none).join(targets.select("source_no", "source_size", "target"), "source_no")
    return found.select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as rows of ``docs``: one for each pass over a document, whose text is what that pass takes of it.

    A pass that takes all blocks of a document has its text unchanged; of others, the taken words stand in
    order with one space between them. Documents of which nothing is taken are gone.
    """
    rows, targets = placed(docs)
    part = F.struct("first", "words", "times")
    parts = takings(rows, targets, block, shard_slots).groupBy("doc_id", "text_key", "source_no", "start").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("times").alias("passes")).where("passes > 0")
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_key", "source_no").orderBy("start"))
    parts = parts.select("doc_id", "text_key", "source_no", nth.alias("nth"), "parts", "passes")
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_key"), F.col("source").cast("string").alias("own_source"))
    marked = marked.join(_few(targets.select("source", F.col("source_no").alias("own_no"))), marked.own_source.eqNullSafe(targets.source)).select("row", "own_id", "own_key", "own_no")
    marked = marked.withColumn("own_nth", F.row_number().over(Window.partitionBy("own_id", "own_key", "own_no").orderBy(row_hash(docs))))
    joined = marked.join(parts, marked.own_id.eqNullSafe(parts.doc_id) & (marked.own_key == parts.text_key) & (marked.own_no == parts.source_no) & (marked.own_nth == parts.nth))
    each = joined.select("row", "parts", F.explode(F.sequence(F.lit(1).cast("long"), "passes")).alias("pass"))
    words = F.filter(F.split(F.col("row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    taken = F.filter("parts", lambda p: p.times >= F.col("pass"))
    pieces = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(taken, lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")))), " "))[0]
    each = each.withColumn("taken_text", F.when(F.forall("parts", lambda p: p.times >= F.col("pass")), F.col("row.text")).otherwise(pieces))
    columns = [F.col("taken_text").cast(f.dataType).alias(f.name) if f.name == "text" else F.length("taken_text").cast(f.dataType).alias(f.name) if f.name == "n_chars" else F.col("row")[f.name].alias(f.name) for f in docs.schema.fields]
    return each.select(*columns)


def oracle_sql() -> str:
    """The mix with the default settings, over the table documents."""
    bucket = f"coalesce({mix_sql('doc_id & 9223372036854775807', '3', '5')} % (SELECT greatest(1, (count(*) + {BUCKET_ROWS - 1}) // {BUCKET_ROWS}) FROM r), 0)"
    return f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1)::BIGINT AS source_no FROM r GROUP BY source
), s1 AS (
  SELECT *, source_no % 3 + 1 AS weight FROM s0
), s2 AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    ({MOST} * (sum(source_size) OVER room - source_size))::BIGINT AS capped,
    (sum(weight) OVER () - sum(weight) OVER room + weight)::BIGINT AS open_weight, row_number() OVER room AS nth
  FROM s1 WINDOW room AS (ORDER BY source_size::DOUBLE / weight, source_no ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT nth, total - capped AS rest, open_weight FROM s2 WHERE weight * (total - capped) <= {MOST} * source_size * open_weight ORDER BY nth LIMIT 1
), s3 AS (
  SELECT s2.source, source_no, source_size, CASE WHEN s2.nth < level.nth THEN ({MOST} * source_size)::DOUBLE ELSE (weight * rest)::DOUBLE / level.open_weight::DOUBLE END AS target FROM s2, level
), s4 AS (
  SELECT *, ceil(source_size / {BLOCK})::BIGINT AS blocks FROM s3 WHERE source_size > 0
), s5 AS (
  SELECT *, floor(target / source_size * blocks + 0.5)::BIGINT AS slots FROM s4
), k AS (
  SELECT source_no, blocks, unnest(range(slots)) AS k FROM s5
), p AS (
  SELECT k.source_no, k.blocks, k // k.blocks AS pass_no, k % k.blocks AS x, sum_before + k AS y, (SELECT sum(slots) FROM s5)::BIGINT AS n, 0::BIGINT AS r
  FROM k JOIN (SELECT source_no, (sum(slots) OVER (ORDER BY source_no) - slots)::BIGINT AS sum_before FROM s5) USING (source_no)
  UNION ALL
  SELECT source_no, blocks, pass_no, {swap_sql('x', 'blocks', *constants_sql('r', 'blocks', 'source_no * 4 + pass_no + 1'))}, {swap_sql('y', 'n', *constants_sql('r', 'n', '0'))}, n, r + 1 FROM p WHERE r < {ROUNDS}
), used AS (
  SELECT source_no, x AS block_no, count(*) AS times, min(y // {SHARD_SLOTS}) AS first_shard FROM p WHERE r = {ROUNDS} GROUP BY ALL
), placed AS (
  SELECT doc_id, source_no, size, (sum(size) OVER (PARTITION BY source_no ORDER BY {bucket}, doc_id ASC NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM r JOIN s3 ON r.source IS NOT DISTINCT FROM s3.source
), parts AS (
  SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block_no FROM placed WHERE size > 0
), taken AS (
  SELECT doc_id, source_no, start, size, sum((least(start + size, (block_no + 1) * {BLOCK}) - greatest(start, block_no * {BLOCK})) * coalesce(times, 0))::BIGINT AS taken, min(first_shard)::BIGINT AS first_shard
  FROM parts LEFT JOIN used USING (source_no, block_no) GROUP BY ALL
  UNION ALL SELECT doc_id, source_no, start, size, 0, NULL FROM placed WHERE size = 0
)
SELECT doc_id, size, source_size, target, taken, first_shard FROM taken JOIN s3 USING (source_no)
"""
