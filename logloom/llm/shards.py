"""Operator 6: token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by doc_id (ties by text), encoded, and written by each task as one shard:

    block   entries (varints: bytes shared with the key before, bytes that follow, bytes of the value; then key and
            value), a new block at BLOCK bytes with its first key whole; stored compressed, behind its own length, with
            the CRC-32 of what is stored behind it
    index   for each block: its last key, offset and length
    bloom   bits over XXH64 of the keys, PROBES probes by double hashing
    footer  offsets and lengths of index and bloom, number of documents and ids, bytes of an id, magic; fixed length

Keys are doc_ids in an order-preserving form (null first). Values are ids as little-endian unsigned integers, of two
bytes where the vocabulary has at most 65,536 of them, else of four. A lookup asks the Bloom filter, finds the block by
binary search in the index, and reads that block alone.

Encoding is the tokenizers library's. A text is cut at single blanks and line breaks between other characters: the
tokenizer's own first step always cuts before these, so the ids of the parts, kept in a table of bounded size, are
those of the text. Texts with other white space, or with the string of a special token, are encoded whole.

Tasks name their files by themselves and report them in a table; what a lost or repeated attempt has left is never read.

Defined results: a null text is the empty text and has the end id alone; null doc_ids come first; rows that repeat a
doc_id are separate entries in the order of a hash of their texts (a lookup gives the first); very long texts are one entry; an empty table gives no shards
and no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dealt, fresh, open_fs, slices, small_batches, stored, table, texts

END = 2
BLOCK = 1 << 16
BITS, PROBES = 10, 7
FOOTER, MAGIC = struct.Struct("<7Q8s"), b"LOOMSST2"
CODEC = "zstd"
#: Parts of texts, of a generation and of this length at most, whose ids are kept in each worker.
KEPT_PARTS, KEPT_CHARS = 1_000_000, 200
#: Parts that are encoded as one text, and the character that stands for a blank in byte-level vocabularies.
JOINED, BLANK = 1000, "\u0120"
#: White space at which no text is cut.
OTHER_SPACE = re.compile(r"[^\S \n]")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian bytes, by a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(1 + max(vocabulary.values()), bool)
        self.starts[[i for t, i in vocabulary.items() if t[:1] == BLANK]] = True
        self.width = 2 if len(self.starts) <= 1 << 16 else 4
        # two generations: a full one becomes the old one, from which what is met again moves back
        self.parts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.width == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, parts: list[str]) -> None:
        """Adds the ids of parts that follow a blank. They are encoded as one text, which costs less than a text each;
        an id that starts with a blank starts a part, for parts have no other."""
        for start in range(0, len(parts), JOINED):
            own = parts[start : start + JOINED]
            (data,) = self.whole([" " + " ".join(own)])
            at = np.flatnonzero(self.starts[np.frombuffer(data, f"<u{self.width}")])
            if len(at) != len(own):
                raise ValueError("the tokenizer does not cut before blanks")
            ends = [*(at * self.width).tolist(), len(data)]
            self.parts.update((p, data[a:b]) for p, a, b in zip(own, ends, ends[1:]))

    def cut(self, text: str) -> list[str] | None:
        """The parts of a text: what stands before the first blank, marked by one, and what follows each (a line break stands
        in front of its part). None if the text has to be encoded whole."""
        if OTHER_SPACE.search(text) or any(map(text.__contains__, self.special)):
            return None
        text = text.replace("\n", " \n")
        if "  " in text or "\n " in text or text[-1:] in " \n":  # an empty part, or a line break alone
            return None
        parts = text.split(" ")
        if not parts[0]:
            return None
        parts[0] = " " + parts[0]
        return parts

    def encode(self, batch: list[str]) -> list[bytes]:
        if len(self.parts) >= KEPT_PARTS:
            self.old, self.parts = self.parts, {}
        known, old = self.parts, self.old
        plans = list(map(self.cut, batch))
        fresh = set().union(*(p for p in plans if p is not None)).difference(known)
        found = old.keys() & fresh
        known.update((p, old[p]) for p in found)
        new = list(fresh - found)
        alone = [p for p in new if p[:1] in ("\n", " ")]
        known.update(zip(alone, self.whole([p.removeprefix(" ") for p in alone])))
        self.joined([p for p in new if p[:1] not in ("\n", " ")])
        whole = iter(self.whole([t for t, p in zip(batch, plans) if p is None]))
        out = [next(whole) if p is None else b"".join(map(known.__getitem__, p)) for p in plans]
        for part in new:
            if len(part) > KEPT_CHARS:
                del known[part]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def probes(hashes: np.ndarray, m: int) -> np.ndarray:
        step = hashes >> np.uint64(32) | np.uint64(1)
        return (hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(m)

    @classmethod
    def of(cls, hashes: list[int]) -> Bloom:
        m = max(64, -(-len(hashes) * BITS // 8) * 8)
        bits = np.zeros(m // 8, np.uint8)
        at = cls.probes(np.array(hashes, np.uint64), m).ravel()
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return cls(bits)

    def may_have(self, key: bytes) -> bool:
        at = self.probes(np.array([xxhash.xxh64_intdigest(key)], np.uint64), len(self.bits) * 8)[0]
        return all(self.bits[int(i) >> 3] >> (int(i) & 7) & 1 for i in at)


class Writer:
    """A shard, written entry by entry in ascending key order."""

    def __init__(self, out: pa.NativeFile, width: int = 4):
        self.out, self.width, self.at, self.block, self.last = out, width, 0, bytearray(), b""
        self.codec = pa.Codec(CODEC)
        self.index: list[bytes] = []
        self.hashes: list[int] = []
        self.n_ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            limit = min(len(key), len(self.last))
            while shared < limit and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.n_ids += len(value) // self.width
        if len(self.block) >= BLOCK:
            self._flush()

    def _write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def _flush(self) -> None:
        if self.block:
            data = _varint(len(self.block)) + self.codec.compress(bytes(self.block), asbytes=True)
            start = self._write(data + struct.pack("<I", zlib.crc32(data)))
            self.index.append(_varint(len(self.last)) + self.last + _varint(start) + _varint(len(data)))
            self.block.clear()

    def close(self) -> None:
        self._flush()
        index, bloom = b"".join(self.index), Bloom.of(self.hashes).bits.tobytes()
        places = self._write(index), len(index), self._write(bloom), len(bloom)
        self._write(FOOTER.pack(*places, len(self.hashes), self.n_ids, self.width, MAGIC))
        self.out.close()


class Shard:
    """A shard for reading: footer, index and Bloom filter are held, blocks are read as they are asked for."""

    def __init__(self, path: str):
        fs, name = open_fs(path)
        self.file, self.codec = fs.open_input_file(name), pa.Codec(CODEC)
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        data, at = self._read(index_at, index_n), 0
        self.keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.keys.append(data[at : at + n])
            start, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.blocks.append((start, length))
        self.bloom = Bloom(np.frombuffer(self._read(bloom_at, bloom_n), np.uint8))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        start, n = self.blocks[i]
        data = self._read(start, n + 4)
        if zlib.crc32(data[:n]) != struct.unpack("<I", data[n:])[0]:
            raise ValueError("a block is damaged")
        n, at = _read_varint(data, 0)
        data, at, key = self.codec.decompress(data[at:-4], n, asbytes=True), 0, b""
        while at < n:
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            yield key, data[at + own : at + own + size]
            at += own + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def ids(self, value: bytes) -> np.ndarray:
        """A value's ids, as 32-bit integers."""
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def get(self, doc_id: int | None) -> list[int] | None:
        """The ids of a document, or None."""
        key = key_of(doc_id)
        i = bisect.bisect_left(self.keys, key)
        if i == len(self.keys) or not self.bloom.may_have(key):
            return None
        return next((self.ids(v).tolist() for k, v in self.block(i) if k == key), None)

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the shards. Returns path, first_id, n_docs, n_ids and start (ids in the shards before) of each."""
    spark = docs.sparkSession
    small_batches(spark)
    path, folder = path or tokenizer_path(), fresh(spark, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        end = END.to_bytes(own.width, "little")
        fs, top = open_fs(folder)
        name, shard, first = f"/{uuid.uuid4().hex}.sst", None, (None, 0)
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            if shard is None:
                fs.create_dir(top, recursive=True)
                shard, first = Writer(fs.open_output_stream(top + name, compression=None), own.width), (ids[0], batch.column("place")[0].as_py())
            for doc_id, value in zip(ids, own.encode(batch.column("text").to_pylist())):
                shard.add(key_of(doc_id), value + end)
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_pylist([{"path": name, "first_id": first[0], "first_place": first[1], "n_docs": len(shard.hashes), "n_ids": shard.n_ids}], kinds)

    kinds = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("first_place", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    # texts of one doc_id, null above all, may be many: they are dealt out by a hash of the text
    order = F.col("doc_id").asc_nulls_first(), F.col("place").asc()
    rows = texts(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("place"), "text").repartitionByRange(*order)
    shards = rows.sortWithinPartitions(*order, "text").mapInArrow(run, "path string, first_id long, first_place long, n_docs long, n_ids long")
    shards = stored(shards.withColumn("path", F.concat(F.lit(folder), "path")), "manifest")
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_place").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return stored(shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "shards")


def read(shards: DataFrame) -> DataFrame:
    """shards(path, start): doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(path)
                for i in range(len(shard.blocks)):
                    rows = []
                    for key, value in shard.block(i):
                        ids = shard.ids(value)
                        rows.append({"doc_id": id_of(key), "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids)})
                        start += len(ids)
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                shard.close()

    return dealt(shards.select("path", "start")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))
