"""Token ids in a binary store with directly addressable codes.

A store is a table of segments. Each segment holds the ids of consecutive documents as one
self-contained block of bytes: a header, the documents' ids and first positions, and the codes. An id is
cut into chunks of eight bits. The lowest chunks of all ids stand in level 0; an id that needs more bits
has a set bit in the level's continuation bitmap, and its next chunk stands in the next level at the rank
of that bit. A directory of ranks, one for every 512 bits, gives that rank without decoding, so any token
is reached in one step a level.

Text may be null or empty (a document of the end id alone); ids may be null (they come first) or repeated
(rows of one id stand side by side, ordered by text); an empty table gives a store without segments.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, trimmed

#: First bytes of a segment; the number is the format's version.
MAGIC = b"TDAC0001"
#: Bits between two entries of a rank directory.
RANK_BITS = 512
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint32)

SEGMENTS = "part int, seq int, n_docs long, n_tokens long, payload binary"


def encode_levels(ids: np.ndarray) -> bytes:
    """The codes of ``ids`` (unsigned 32-bit integers)."""
    rest, out = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bitmap) // 64) * 64, dtype=np.uint8)
        padded[: len(bitmap)] = bitmap
        ranks = np.concatenate([[0], np.cumsum(_POPCOUNT[padded].reshape(-1, 64).sum(axis=1))]).astype("<u4")
        out.append(struct.pack("<Q", len(rest)) + ranks.tobytes() + padded.tobytes() + (rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    return struct.pack("<I", len(out)) + b"".join(out)


class Segment:
    """A segment's bytes, opened for random access and for whole reads."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a token segment")
        n_docs, self.n_tokens = struct.unpack_from("<QQ", payload, 8)
        at = 24
        self.doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
        at += 8 * n_docs
        self.doc_null = np.frombuffer(payload, np.uint8, n_docs, at).astype(bool)
        at += n_docs
        self.starts = np.frombuffer(payload, "<u8", n_docs + 1, at)
        at += 8 * (n_docs + 1)
        (levels,) = struct.unpack_from("<I", payload, at)
        at += 4
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            at += 8
            blocks = -(-n // RANK_BITS)
            ranks = np.frombuffer(payload, "<u4", blocks + 1, at)
            at += 4 * (blocks + 1)
            bitmap = np.frombuffer(payload, np.uint8, 64 * blocks, at)
            at += 64 * blocks
            self.levels.append((ranks, bitmap, np.frombuffer(payload, np.uint8, n, at)))
            at += n

    def token(self, i: int) -> int:
        """The id at position ``i`` of the segment, without decoding any other."""
        value = 0
        for k, (ranks, bitmap, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                return value
            block = i // RANK_BITS
            i = int(ranks[block]) + int(_POPCOUNT[bitmap[block * 64 : byte]].sum()) + bin(int(bitmap[byte]) & ((1 << bit) - 1)).count("1")
        raise ValueError("a code continues beyond the last level")

    def ids(self) -> np.ndarray:
        """All ids of the segment."""
        value = np.zeros(0, dtype=np.uint32)
        for _, bitmap, chunks in reversed(self.levels):
            here = chunks.astype(np.uint32)
            more = np.unpackbits(bitmap, bitorder="little", count=len(chunks)).astype(bool)
            here[more] |= value << 8
            value = here
        return value


def pack_segment(doc_ids: list, pieces: list[bytes]) -> bytes:
    """A segment's bytes from its documents' ids and the little-endian 32-bit token ids of each."""
    lengths = np.array([len(x) // 4 for x in pieces], dtype="<u8")
    starts = np.concatenate([np.zeros(1, "<u8"), np.cumsum(lengths, dtype="<u8")])
    return b"".join([
        MAGIC, struct.pack("<QQ", len(pieces), int(starts[-1])), np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], np.uint8).tobytes(), starts.astype("<u8").tobytes(), encode_levels(np.frombuffer(b"".join(pieces), "<u4")),
    ])


class _Known:
    """Word to its ids (little-endian), in two tables of at most ``keep`` words: when the younger is full, it replaces the older."""

    def __init__(self, keep: int):
        self.keep, self.young, self.old = keep, {}, {}

    def of(self, words: list[str], encoded: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of different words; ``encoded`` gives those of words that aren't in the tables."""
        out = list(map(self.young.get, words))
        new = [k for k, ids in enumerate(out) if ids is None]
        for k in new:
            out[k] = self.old.get(words[k])
        missing = [k for k in new if out[k] is None]
        for k, ids in zip(missing, encoded([words[k] for k in missing]), strict=True):
            out[k] = ids
        for k in new:
            if len(self.young) >= self.keep:
                self.old, self.young = self.young, {}
            self.young[words[k]] = out[k]
        return out


def _shown() -> np.ndarray:
    """The characters that stand for bytes in a byte-level vocabulary: for those that can be seen themselves,
    for the others from 0x80 on U+0122 and on in order (the first 34 places are other bytes'). White space stays."""
    hidden = [*range(0x80, 0xA1), 0xAD]
    out = np.arange(256, dtype="<u4")
    out[hidden] = np.arange(0x122, 0x122 + len(hidden))
    return out


class WordEncoder:
    """Token ids of whole texts by a tokenizer whose pre-tokens never cross ASCII white space.

    A text's ids are then the ids of its words one after another. Arrow splits the texts and tells words
    apart, so Python sees different words only. Plain Latin letters are one pre-token and marks after them
    another: such a word is its letters in lower case, then its marks. Different runs of letters go to the
    tokenizer's model many at a time, and the ids are cut where a token ends a word. Marks and every other
    word are encoded by the whole tokenizer. What has been encoded is kept in tables of bounded size. The
    tests compare all this with the encoding of whole texts.
    """

    #: Latin letters that case folding and composition map to one letter each, and marks of one pre-token.
    LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", ".,!?;:%&*#$|"

    def __init__(self, tokenizer_file: str, keep: int = 250_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.letters, self.others = _Known(keep), _Known(max(1, keep // 4))
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix or "", self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.shown = _shown()

    def whole(self, words: list[str]) -> list[bytes]:
        """The ids of each word, by the whole tokenizer."""
        return [array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes() for w in words]

    def modelled(self, words: list[str], at_once: int = 256) -> list[bytes]:
        """The same of runs of plain letters in lower case, by the tokenizer's model."""
        out = []
        for at in range(0, len(words), at_once):
            some = words[at : at + at_once]
            text = " ".join(some)
            if not text.isascii():
                text = self.shown[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) == len(some) and ends[-1] == 4 * len(ids):
                held = ids.tobytes()
                out += [held[a:z] for a, z in zip([0, *ends], ends, strict=False)]
            else:
                out += self.whole(some)
        return out

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words one after another, and each word's number of ids; piece by piece: letters, marks after them, words of other kinds."""
        core = pc.ascii_rtrim(words, characters=self.MARKS)
        is_plain = pc.match_substring_regex(core, f"^{self.LETTERS}$")
        plain = is_plain.to_numpy(zero_copy_only=False)
        marked = np.flatnonzero(plain & (pc.binary_length(words).to_numpy() > pc.binary_length(core).to_numpy()))
        letters = pc.utf8_lower(core.filter(is_plain)).dictionary_encode()
        marks = pc.replace_substring_regex(words.take(pa.array(marked)), f"^{self.LETTERS}", "").dictionary_encode()
        pieces = self.letters.of(letters.dictionary.to_pylist(), self.modelled)
        pieces += self.others.of(marks.dictionary.to_pylist(), self.whole) + self.others.of(words.filter(pc.invert(is_plain)).to_pylist(), self.whole)
        ids, sizes = np.frombuffer(b"".join(pieces), "<u4"), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        first, second = np.zeros(len(words), np.int64), len(letters.dictionary) + marks.indices.to_numpy()
        first[plain] = letters.indices.to_numpy()
        first[~plain] = len(letters.dictionary) + len(marks.dictionary) + np.arange(np.count_nonzero(~plain))
        out = sizes[first]
        out[marked] += sizes[second]
        return gathered(ids, sizes, np.insert(first, marked + 1, second)), out

    def encode_all(self, texts: pa.Array, at_once: int = 262_144) -> list[bytes]:
        """The little-endian ids of each text; null is empty. ``at_once``: words whose ids are put together at a time."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        found = cut.flatten().dictionary_encode()
        ids, sizes = self.words(found.dictionary)
        of = found.indices.to_numpy()
        out = [gathered(ids, sizes, of[at : at + at_once]) for at in range(0, len(of), at_once)]
        ends = np.cumsum(np.concatenate([[0], sizes[of]]))[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])]
        whole = memoryview(np.concatenate([np.zeros(0, "<u4"), *out])).cast("B")
        return [bytes(whole[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, text: str) -> bytes:
        """The little-endian ids of a text."""
        return self.encode_all(pa.array([text]))[0]


def gathered(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Runs of ``ids``, whose ``sizes`` are given, one after another as ``order`` names them."""
    n = sizes[order]
    ends = np.cumsum(n)
    starts = (np.cumsum(sizes) - sizes)[order]
    return ids[np.repeat(starts - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def in_bytes(texts: pa.Array, most: int = 1 << 24, rows: int = 8192) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` texts, which hold ``most`` bytes together or are one text."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(total):
        before = int(total[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(total, before + most, "right"))))
        yield at, end
        at = end


@lru_cache(maxsize=1)
def word_encoder(tokenizer_file: str) -> WordEncoder:
    """The encoder of this process: what it knows serves the worker's later tasks too."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(tokenizer_file)


def write_store(docs: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None, segment_tokens: int = 131_072) -> str:
    """Writes the ids of ``docs`` (doc_id, text) in ascending doc_id order; returns the store's path.

    Rows are dealt by ranges of doc_id before they are encoded, so the encoder sees every text once and
    segments come out in global order. ``segment_tokens``: ids after which a segment is closed; one
    document is never cut.
    """
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = word_encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        ids, pieces, size = [], [], 0
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((part, seq, len(ids), size // 4, pack_segment(ids, pieces)), schema, strict=True)], schema=schema)

        for batch in batches:
            for at, z in in_bytes(batch.column("text")):
                some = batch.slice(at, z - at)
                for doc_id, codes in zip(some.column("doc_id").to_pylist(), encoder.encode_all(some.column("text")), strict=True):
                    ids.append(doc_id)
                    pieces.append(codes + end)
                    size += len(pieces[-1])
                    if size >= 4 * segment_tokens:
                        yield closed()
                        ids, pieces, size, seq = [], [], 0, seq + 1
        if pieces:
            yield closed()

    path = path or shared_dir(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(trimmed(run), SEGMENTS).write.parquet(path)
    return path


def read_store(spark, path: str) -> DataFrame:
    """One row per document of the store: doc_id, start, n_tokens, ids_crc32, part, seq, in file order by start."""
    table = spark.read.schema(SEGMENTS).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    first = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("first"))
    heads = table.select("part", "seq", "n_tokens").join(first, "part")
    inside = Window.partitionBy("part").orderBy("seq")
    heads = heads.select("part", "seq", (F.col("first") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = Segment(batch.column("payload")[row].as_py())
                raw, starts = s.ids().astype("<u4").tobytes(), s.starts.astype(np.int64)
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                n = len(sums)
                key = [pa.array(np.full(n, batch.column(k)[row].as_py(), np.int32)) for k in ("part", "seq")]
                yield pa.RecordBatch.from_arrays(
                    [*key, pa.array(s.doc_ids, mask=s.doc_null), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())],
                    names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    docs = table.select("part", "seq", "payload").mapInArrow(trimmed(run), "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(heads, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")
