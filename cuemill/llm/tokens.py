"""Token-ID files: concatenated ids with Elias-Fano coded document boundaries."""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse, islice

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.llm.common import KEPT, bounded_batches, fresh_worker, tasks

MAGIC = b"TIDS"
HEADER = struct.Struct("<4sHHQQqQQ")  # magic, version, id width, documents, ids, first id, 2 sizes
#: Texts that are cut into words at a time: a word takes some ten times its bytes.
ENCODED_ROWS = 256
#: Ones of the high bits between two stored positions.
SELECT_EVERY = 256


class EliasFano:
    """A non-decreasing sequence of integers from 0 in about 2 + log2(universe / n) bits each.

    The low bits are packed; the high bits are a unary bit vector. Every ``SELECT_EVERY``-th one's
    position is kept as 32 bits, so ``access`` scans a few words instead of reading a table of
    64-bit offsets.
    """

    HEAD = struct.Struct("<QBQ")  # values, low bits, bytes of high bits

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls.HEAD.pack(0, 0, 0)
        if (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").tobytes()
        marks = ones[::SELECT_EVERY].astype("<u4").tobytes()
        return (cls.HEAD.pack(n, low_bits, len(high))
                + np.packbits(low, bitorder="little").tobytes() + high + marks)

    @classmethod
    def read(cls, blob: bytes) -> EliasFano:
        n, low_bits, size = cls.HEAD.unpack_from(blob)
        at = cls.HEAD.size
        low = np.frombuffer(blob, np.uint8, (n * low_bits + 7) // 8, at)
        high = np.frombuffer(blob, np.uint8, size, at + len(low))
        marks = np.frombuffer(blob, "<u4", -(-n // SELECT_EVERY), at + len(low) + size)
        return cls(n, low_bits, low, high, marks)

    def access(self, i: int) -> int:
        """The i-th value: select of the i-th one, and its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.marks[i // SELECT_EVERY]), i % SELECT_EVERY
        byte, skip = place // 8, place % 8
        while True:
            chunk = np.unpackbits(self.high[byte:byte + 64], bitorder="little")
            ones = np.flatnonzero(chunk[skip:]) + skip
            if left < len(ones):
                place = byte * 8 + int(ones[left])
                break
            left, byte, skip = left - len(ones), byte + 64, 0
        value = (place - i) << self.low_bits
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= int(self.low[bit // 8] >> (bit % 8) & 1) << k
        return value

    def values(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        low = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little")
        weights = np.int64(1) << np.arange(self.low_bits, dtype=np.int64)
        low = low.reshape(self.n, self.low_bits).astype(np.int64) @ weights
        return ((ones - np.arange(self.n)) << self.low_bits) | low


#: Fixed value: the pattern by which byte-level BPE cuts a text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words whose characters are classed alike by every Unicode version: printable ASCII, line ends, Latin.
PLAIN = regex.compile(r"[!-~\n\u00a1-\u024f]+")


#: A blank behind which no word begins.
LOOSE_BLANK = regex.compile(r" (?:\s|\Z)")
LOOSE_ASCII = ("  ", " \n", " \t", " \r", " \x0b", " \x0c", " \x1c", " \x1d", " \x1e", " \x1f")


def loose_blank(text: str) -> bool:
    if text.isascii():  # substring tests cost next to nothing
        return text.endswith(" ") or any(x in text for x in LOOSE_ASCII)
    return LOOSE_BLANK.search(text) is not None


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves,
    the others, in order, from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder:
    """Texts to id bytes by a tokenizer file; words between blanks are encoded once and kept.

    A byte-level pre-tokenizer always starts a new piece at a blank that no white space follows, so
    a text's ids are its words' ids, each with its blank in front. A new word is cut into pieces and
    these go to the library's BPE model, past the cost of whole encodings. Texts with another blank
    or a special token, words with rarer characters, and other tokenizers are encoded by the library
    as they are.
    """

    #: Longer words and pieces are let go after each batch.
    LONGEST = 64

    def __init__(self, path: str, kept: int = 1_000_000):
        from tokenizers import Tokenizer

        #: Words and pieces to keep, some 150 bytes each.
        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        pre, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
        self.by_word = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                        and not pre.get("add_prefix_space") and not config.get("normalizer")
                        and not config.get("truncation") and not config.get("padding")
                        and model.get("type") == "BPE" and not model.get("ignore_merges"))
        self.special = [t["content"] for t in config.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.long: list[str] = []
        self.model, self.table = self.tokenizer.model, {ord(chr(b)): c for b, c in byte_alphabet().items()}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in
                self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tokenized(self, pieces: Iterable[str], blank: str) -> dict[str, bytes]:
        """Ids of single pieces, ``blank`` put in front, by the BPE model itself."""
        tokenize, table, kind = self.model.tokenize, self.table, "H" if self.dtype.itemsize == 2 else "I"
        own = blank.translate(table)
        return {p: array(kind, [t.id for t in tokenize(
            own + (p if p.isalpha() and p.isascii() else p.encode().decode("latin-1").translate(table)))])
            .tobytes() for p in pieces}

    def _add(self, words: set[str]) -> None:
        """Takes up new words, each with a blank in front."""
        plain = list(filter(PLAIN.fullmatch, words))
        single = set(filter(str.isalpha, plain))
        mixed = list(filterfalse(str.isalpha, plain))
        # A mixed word is a word, the piece behind the blank, and pieces without one.
        pieces = PIECES.findall(" " + " ".join(mixed)) if mixed else []
        heads = {p[1:] for p in pieces if p[0] == " "}
        self.words.update(self._tokenized(single.union(filterfalse(self.words.__contains__, heads)), " "))
        tails = {p for p in pieces if p[0] != " "}
        self.pieces.update(self._tokenized(filterfalse(self.pieces.__contains__, tails), ""))
        parts: list[bytes] = []
        for p in pieces:
            if p[0] == " ":
                parts.append(self.words[p[1:]])
            else:
                parts[-1] += self.pieces[p]
        self.words.update(zip(mixed, parts, strict=True))
        other = list(words.difference(plain))
        self.words.update(zip(other, self._encode([" " + w for w in other])))
        self.long = [w for w in words | heads if len(w) > self.LONGEST]
        for p in tails:
            if len(p) > self.LONGEST:
                del self.pieces[p]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._encode(texts)
        for kept in (self.words, self.pieces):
            if len(kept) > self.kept:  # the older half goes
                for key in list(islice(kept, len(kept) // 2)):
                    del kept[key]
        whole = [loose_blank(t) or any(s in t for s in self.special) for t in texts]
        split = [[t] if w else t.split(" ") for t, w in zip(texts, whole)]
        heads = self._encode([parts.pop(0) for parts in split])
        new: set[str] = set()
        for parts in split:
            new.update(filterfalse(self.words.__contains__, parts))
        self._add(new)
        get = self.words.__getitem__
        out = [head + b"".join(map(get, parts)) for head, parts in zip(heads, split)]
        for word in self.long:
            self.words.pop(word, None)
        return out


@lru_cache(maxsize=1)
def encoder(path: str, kept: int) -> Encoder:
    return Encoder(path, kept)


KEPT.append(encoder.cache_clear)


def pack_shard(doc_ids: list[int], bodies: list[bytes], dtype: np.dtype) -> bytes:
    """One shard: header, coded document ids, coded boundaries, ids."""
    ids = EliasFano.encode(np.array(doc_ids, dtype=np.int64) - doc_ids[0])
    ends = np.cumsum([len(b) // dtype.itemsize for b in bodies])
    bounds = EliasFano.encode(ends)
    return (HEADER.pack(MAGIC, 1, dtype.itemsize, len(doc_ids), int(ends[-1]), doc_ids[0],
                        len(ids), len(bounds)) + ids + bounds + b"".join(bodies))


class Shard:
    """A packed shard; any document's ids without reading the others."""

    def __init__(self, blob: bytes):
        magic, version, width, self.n_docs, self.n_tokens, self.first, a, b = HEADER.unpack_from(blob)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        at = HEADER.size
        self.ids = EliasFano.read(blob[at:at + a])
        self.bounds = EliasFano.read(blob[at + a:at + a + b])
        self.tokens = np.frombuffer(blob, f"<u{width}", self.n_tokens, at + a + b)

    def doc_ids(self) -> np.ndarray:
        return self.ids.values() + self.first

    def document(self, i: int) -> np.ndarray:
        return self.tokens[self.bounds.access(i - 1) if i else 0:self.bounds.access(i)]


SHARDS = "part int, seq int, n_docs long, n_tokens long, payload binary"


def write_token_shards(docs: DataFrame, path: str, tokenizer_file: str, *, id_col: str = "doc_id",
                       text_col: str = "text", end_id: int = 0, shard_tokens: int = 1 << 20,
                       kept_words: int = 1_000_000) -> None:
    """Encodes every text and writes the shards below ``path``, in ascending id order.

    The texts are dealt out by id range, so one shuffle sorts them; each task encodes its range and
    packs shards of about ``shard_tokens`` ids, ``end_id`` behind every document. Null texts are
    empty documents. A worker keeps the ids of up to ``kept_words`` words (some 150 bytes each) and as many
    pieces: fewer take less memory and more time. Rows without an id are left out; rows that share one stay, ordered by text.
    """
    bounded_batches(docs.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh_worker(encoder.cache_clear)
        enc = encoder(tokenizer_file, kept_words)
        part, seq, size = TaskContext.get().partitionId(), 0, enc.dtype.itemsize
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        ids: list[int] = []
        bodies: list[bytes] = []
        held = 0

        def shard() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(ids)],
                                 "n_tokens": [held], "payload": [pack_shard(ids, bodies, enc.dtype)]})

        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            for at in range(0, len(texts), ENCODED_ROWS):
                codes = enc.encode(texts[at:at + ENCODED_ROWS])
                for i, body in zip(batch["id"].iloc[at:at + ENCODED_ROWS], codes):
                    ids.append(int(i))
                    bodies.append(body + end)
                    held += len(bodies[-1]) // size
                    if held >= shard_tokens:
                        yield shard()
                        ids, bodies, held, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = (rows.where("id IS NOT NULL").repartitionByRange(tasks(docs), "id")
            .sortWithinPartitions("id", "text"))
    rows.mapInPandas(pack, SHARDS).write.parquet(path)


def read_token_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the shards: id, global start, number of ids, crc32 of its ids."""
    bounded_batches(spark)
    shards = spark.read.schema(SHARDS).parquet(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, seq, blob in zip(batch["part"], batch["seq"], batch["payload"]):
                shard = Shard(blob)
                ends = shard.bounds.values()
                starts = np.concatenate([[0], ends[:-1]])
                wide = shard.tokens.astype("<u4")
                yield pd.DataFrame({
                    "part": part, "seq": seq, id_col: shard.doc_ids(), "place": starts,
                    "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(wide[a:b]) for a, b in zip(starts, ends)]})

    docs = shards.select("part", "seq", "payload").mapInPandas(
        unpack, f"part int, seq int, `{id_col}` long, place long, n_tokens long, ids_crc32 long")
    # Ids before a shard: of earlier parts, and of earlier shards of its part.
    meta = shards.select("part", "seq", F.col("n_tokens").alias("held"))
    parts = meta.groupBy("part").agg(F.sum("held").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    meta = meta.withColumn("inside", F.coalesce(F.sum("held").over(inside), F.lit(0)))
    bases = meta.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("base"))
    return docs.join(bases, ["part", "seq"]).select(
        id_col, (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
