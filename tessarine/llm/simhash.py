"""Near duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

A text's words (A-Z lower-cased) give shingles, a text of fewer words its whole sequence, and a text
without words the fingerprint zero. A bit of the fingerprint is set if it is set in over half of the
shingles' hashes. Two fingerprints within ``radius`` bits share a word within half the radius of both, so
every distinct fingerprint emits all words within that half, and those that meet on a word are linked.
With an even radius everything that meets is within the radius (triangle inequality); links are verified
all the same. At most 1 + 64 fingerprints meet on a word at radius 2, whatever the size of a group of copies.

Null and empty texts are linked like any other fingerprint zero. Repeated rows and ids are all kept; a
component of null ids alone has the null id. Other columns of the documents don't take part and stay as they are. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.staging import staged
from .common import in_parts, row_hash, trimmed

BITS = 64


def fingerprints(texts: list[bytes | None], width: int = 3, block: int = 200_000) -> np.ndarray:
    """Fingerprints (unsigned) of UTF-8 texts. ``block``: shingles whose bits are laid out at once."""
    from xxhash import xxh64_intdigest

    out, parts, sizes, rows, held = np.zeros(len(texts), np.uint64), [], [], [], 0

    def flush():
        bits = np.unpackbits(np.concatenate(parts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        major = 2 * ones > np.array(sizes)[:, None]
        out[rows] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()

    for row, text in enumerate(texts):
        words = (text or b"").lower().split()
        if not words:
            continue
        shingles = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else (words,)
        n = max(1, len(words) - width + 1)
        parts.append(np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(42)), "<u8", n))
        sizes.append(n)
        rows.append(row)
        held += n
        if held >= block:
            flush()
            parts, sizes, rows, held = [], [], [], 0
    if parts:
        flush()
    return out


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) of every row; text_key is a hash of the text that tells apart rows of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(in_parts, batches)):
            fps = fingerprints(batch.column("text").cast(pa.binary()).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(trimmed(run), "doc_id long, text_key long, fp long")


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (src, dst) between distinct fingerprints ``fp`` within ``radius`` bits, enough to connect all that are.

    What meets on a word is linked in a chain, not in all pairs. An odd radius raises ValueError: half of it reaches no word that both ends share.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    masks = [0, *(sum(1 << b for b in bits) for n in range(1, radius // 2 + 1) for bits in combinations(range(BITS), n))]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    variants = fps.select("fp", F.explode(F.transform(F.lit(signed).cast("array<bigint>"), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = variants.select("fp", before.alias("other")).where("other is not null")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius).select(F.col("fp").alias("src"), F.col("other").alias("dst")).distinct()


def classes(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component_id, keep): the smallest doc_id of each fingerprint's component and its (doc_id, text_key)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")
    distinct = staged(rows.groupBy("fp").agg(first))
    linked = connected_components(ball_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), "first")
    kept = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    return rooted.join(kept, "root").select("fp", F.col("keep.doc_id").alias("component_id"), "keep")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """Every row's doc_id, fingerprint (16 hex digits) and component_id."""
    rows = staged(with_fingerprints(docs, width))
    found = rows.join(classes(rows, radius).select("fp", "component_id"), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest doc_id, null ids last."""
    rows = staged(with_fingerprints(docs, width))
    keep = classes(rows, radius).select(F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_key").alias("keep_key")).distinct()
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_key"))
    marked = marked.join(keep, marked.own_id.eqNullSafe(keep.keep_id) & (marked.own_key == keep.keep_key), "left_semi")
    one = F.row_number().over(Window.partitionBy("own_id", "own_key").orderBy(row_hash(docs)))
    return marked.withColumn("nth", one).where("nth = 1").select("row.*")
