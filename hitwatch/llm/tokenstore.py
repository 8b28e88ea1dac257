"""Token-id shards: one concatenated id array a file, with Elias-Fano coded document boundaries and ids.

Documents are range-partitioned and sorted by id, and by a hash of their text, so that an id of very many rows is spread too; each task tokenises its range and writes files of at most
about ``shard_ids`` ids: a header, document ids and boundaries as Elias-Fano sequences with select samples,
then the ids, two bytes each where the vocabulary allows. A file is only listed if its task committed, so
repeated attempts leave orphans that no reader opens. Reading back selects the boundaries run by run, from the sampled
place before each, and adds the ids of earlier files; no table of all boundaries is made.

Defined cases: a null text is empty and has just the end id; a null document id sorts first; documents with
equal ids stay next to each other, in the order of their texts' hashes; an empty table makes no file and no row.
Words are tokenised independently of each other, so each distinct word is encoded once while a worker keeps it.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hitwatch.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MAGIC = b"HWTOK1\0\0"
HEADER = struct.Struct("<8sIIQQqQ")  # magic, id width, select step, documents, null ids, least id, token ids
SELECT_EVERY = 256
SUFFIX = ".hwtok"
#: Documents read together from a shard.
READ_DOCS = 4 * SELECT_EVERY


class EliasFano:
    """Nondecreasing whole numbers in about 2 + log2(largest / n) bits each, with direct access to any of them."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, "u8")
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        ones = (values >> np.uint64(low_bits)).astype("i8") + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, bool)
        bits[ones] = True
        # a bit at a time, so that no table of 64-bit cells is made
        low = np.empty((n, low_bits), "u1")
        for b in range(low_bits):
            low[:, b] = (values >> np.uint64(b)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(low.ravel()).tobytes(), np.packbits(bits).tobytes(), ones[::SELECT_EVERY].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QIIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview) -> tuple[EliasFano, int]:
        n, low_bits, low, high, samples = struct.unpack_from("<QIIII", data)
        at = struct.calcsize("<QIIII")
        end = at + low + high
        return cls(n, low_bits, bytes(data[at : at + low]), bytes(data[at + low : end]), np.frombuffer(data[end : end + 4 * samples], "<u4")), end + 4 * samples

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, "u8")
        begin, end = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, "u1")[begin // 8 : -(-end // 8)])[begin % 8 : begin % 8 + end - begin]
        return bits.reshape(count, self.low_bits).astype("u8") @ (np.uint64(1) << np.arange(self.low_bits, dtype="u8"))

    def select(self, i: int) -> int:
        """Value number ``i``: scan from the sampled one before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        begin, rest = int(self.samples[i // SELECT_EVERY]), i % SELECT_EVERY
        high, at = np.frombuffer(self.high, "u1"), begin
        while True:
            byte = at // 8
            bits = np.unpackbits(high[byte : byte + 64])
            ones = np.flatnonzero(bits[at - 8 * byte :])
            if len(ones) > rest:
                return ((at + int(ones[rest]) - i) << self.low_bits) | int(self._lows(i, 1)[0])
            rest -= len(ones)
            at = 8 * byte + len(bits)

    def run(self, first: int, count: int) -> np.ndarray:
        """Values ``first`` to ``first + count - 1``: from the sampled place before them over as many high bits as they take."""
        if not 0 <= first <= first + count <= self.n:
            raise IndexError((first, count))
        high, skip = np.frombuffer(self.high, "u1"), first % SELECT_EVERY
        if not count:
            return np.zeros(0, "u8")
        at = int(self.samples[first // SELECT_EVERY])
        last = (first + count - 1) // SELECT_EVERY + 1  # the sample after the run ends the scan
        end = int(self.samples[last]) if last < len(self.samples) else 8 * len(high)
        bits = np.unpackbits(high[at // 8 : -(-end // 8)])[at % 8 :]
        ones = np.flatnonzero(bits)[skip : skip + count].astype("u8") + np.uint64(at)
        return ((ones - np.arange(first, first + count, dtype="u8")) << np.uint64(self.low_bits)) | self._lows(first, count)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, "u1")))[: self.n].astype("u8")
        return ((ones - np.arange(self.n, dtype="u8")) << np.uint64(self.low_bits)) | self._lows(0, self.n)


class Words:
    """Token ids of texts whose words are tokenised independently: each distinct word is encoded once while it is kept.

    Splitting, counting and gathering are Arrow and NumPy operations on whole batches. Texts with characters
    beyond Latin letters and common punctuation, or with special tokens, are encoded whole by the library.
    """

    #: Letters, digits and white space of the characters handled here; all Unicode versions class and lower-case them alike.
    LETTERS, DIGITS, SPACES = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾", "\t-\r\x85\xa0"
    ODD = "[^\x00-įı-ɏ‐-‧€]|<\\|"
    #: Fixed value: what the word-level pre-tokeniser takes besides runs of letters.
    OTHERS = f"'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^{SPACES} {DIGITS}{LETTERS}]+"
    #: Fixed value: the tokenizer's own pattern of words, which the two above restate for the characters handled here.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MOST = 100_000
    SEPARATOR = "\x01"

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        parts = json.loads(self.library.to_str())
        self.by_words = self._independent(parts)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        mark = self.library.encode(self.SEPARATOR, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    @classmethod
    def _independent(cls, parts: dict) -> bool:
        """Whether the file's rules are those that are followed here: composed and lower-cased text, split by the known pattern, nothing added."""
        members = lambda step, kind: (step or {}).get(kind) or ([step] if step else [])
        normal = [n.get("type") for n in members(parts.get("normalizer"), "normalizers")]
        splits = [s for s in members(parts.get("pre_tokenizer"), "pretokenizers") if s.get("type") == "Split"]
        known = len(splits) == 1 and splits[0].get("pattern") == {"Regex": cls.SPLIT} and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True
        return normal == ["NFC", "Replace", "Lowercase"] and known and not parts.get("post_processor")

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, words: list[str], together: int = 256) -> list[bytes]:
        """Ids of words, asked for in runs with a separator that is a token of its own."""
        if self.mark is None or any(self.SEPARATOR in w for w in words):
            return self._each(words)
        runs = [words[i : i + together] for i in range(0, len(words), together)]
        out: list[bytes] = []
        for run, got in zip(runs, self.library.encode_batch_fast([f" {self.SEPARATOR} ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, f"<u{self.width}")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(run) - 1:
                out += self._each(run)
                continue
            raw = ids.tobytes()
            bounds = [0, *((ends + 1) * self.width).tolist(), len(raw) + self.width]
            out += [raw[a : b - self.width] for a, b in zip(bounds, bounds[1:], strict=False)]
        return out

    def of(self, words: list[str]) -> list[bytes]:
        found = list(map(self.known.get, words))
        missing = []
        for i, got in enumerate(found):
            if got is None:
                got = self.older.get(words[i])
                if got is None:
                    missing.append(i)
                else:
                    found[i] = self.known[words[i]] = got
        for i, got in zip(missing, self._ask([words[i] for i in missing]), strict=True):
            found[i] = self.known[words[i]] = got
        if len(self.known) > self.MOST:  # words that stay in use move on to the next generation
            self.known, self.older = {}, self.known
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        if not self.by_words or pc.any(pc.match_substring_regex(texts, self.ODD)).as_py():
            if self.by_words:
                odd = pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(odd[1:] != odd[:-1]) + 1).tolist(), len(odd)]
                parts = [self._whole(texts.slice(a, b - a)) if odd[a] else self.encode(texts.slice(a, b - a)) for a, b in zip(edges, edges[1:], strict=False)]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return self._whole(texts)
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts), self.OTHERS, r" \0 ")
        split = pc.split_pattern(pc.replace_substring_regex(spaced, f"[{self.SPACES}]", " "), " ")
        offsets = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        ids = self.of(coded.dictionary.to_pylist())
        flat, sizes = np.frombuffer(b"".join(ids), f"<u{self.width}"), np.fromiter(map(len, ids), "i4", len(ids)) // self.width
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        begins, ends = (np.cumsum(sizes, dtype="i4") - sizes)[codes], np.cumsum(each, dtype="i4")
        at = np.arange(ends[-1] if len(ends) else 0, dtype="i4") + np.repeat(begins - (ends - each), each)
        return flat[at], np.add.reduceat(each, offsets[:-1] - offsets[0]).astype("i8") if len(texts) else np.zeros(0, "i8")

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self._each(texts.to_pylist())
        return np.frombuffer(b"".join(ids), f"<u{self.width}"), np.array([len(i) // self.width for i in ids], "i8")


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with the end id after each document's."""
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    ends = np.zeros(len(out), bool)
    ends[np.cumsum(counts + 1) - 1] = True
    out[~ends] = ids
    return out


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard; document ids are in ascending order, nulls first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], "i8")
    least = int(known[0]) if len(known) else 0
    head = HEADER.pack(MAGIC, ids.itemsize, SELECT_EVERY, len(doc_ids), nulls, least, len(ids))
    names = EliasFano.of((known - least).view("u8") if len(known) else known)
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(counts)]))
    return b"".join([head, names.to_bytes(), bounds.to_bytes(), ids.tobytes()])


class Shard:
    """A shard read back."""

    def __init__(self, data: bytes) -> None:
        view = memoryview(data)
        magic, width, _, self.n, self.nulls, self.least, n_ids = HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        self.names, used = EliasFano.read(view[at:])
        at += used
        self.bounds, used = EliasFano.read(view[at:])
        at += used
        self.ids = np.frombuffer(view[at : at + width * n_ids], f"<u{width}")
        if len(self.ids) != n_ids:
            raise ValueError("truncated token shard")

    def doc_ids(self, first: int = 0, count: int | None = None) -> list[int | None]:
        """Document ids of a run of the shard, or of all."""
        end = self.n if count is None else first + count
        nulls = max(0, min(end, self.nulls) - first)
        known = self.names.run(first + nulls - self.nulls, end - first - nulls) if end > first + nulls else np.zeros(0, "u8")
        return [None] * nulls + (known.view("i8") + self.least).tolist()

    def tokens(self, i: int) -> np.ndarray:
        """Ids of document number ``i`` of the shard."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def write(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_ids: int = 8 << 20) -> DataFrame:
    """Write the shards of ``docs`` under ``folder``; rows (file, part, number, n_docs, n_ids) of what was written, in order."""
    if end_id < 0:
        raise ValueError("end_id must not be negative")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = words(tokenizer), TaskContext.get().partitionId(), 0
        store, root = fs.FileSystem.from_uri(folder)
        names: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            file = f"part-{part:06d}-{number:05d}-{uuid.uuid4().hex}{SUFFIX}"
            flat, each = np.concatenate(ids), np.concatenate(counts)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{file}") as out:
                out.write(pack(names, each, flat))
            row = pa.RecordBatch.from_pylist([{"file": file, "part": part, "number": number, "n_docs": len(each), "n_ids": len(flat)}])
            number += 1
            for kept in (names, counts, ids):
                kept.clear()
            return row

        for batch in batches:
            for a, b in slices(batch.column(1), min(2 << 20, 2 * shard_ids)):
                flat, each = own.encode(batch.column(1).slice(a, b - a))
                names += batch.column(0).slice(a, b - a).to_pylist()
                counts.append(each + 1)
                ids.append(with_end(flat, each, end_id))
                if sum(map(len, ids)) >= shard_ids:
                    yield flush()
            pa.default_memory_pool().release_unused()
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).withColumn("_h", F.xxhash64("_text")).repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h", "_text").select("_id", "_text")
    spark = docs.sparkSession
    done = rows.mapInArrow(put, "file string, part long, number long, n_docs long, n_ids long").collect()  # a row a file
    done.sort(key=lambda r: (r["part"], r["number"]))
    starts = np.cumsum([0, *(r["n_ids"] for r in done)]).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(done, starts, strict=False)], "file string, part long, number long, n_docs long, n_ids long, first long")


def read(spark: SparkSession, folder: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32) of all documents in the listed shards."""
    if not manifest.take(1):
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select(F.substring_index("path", "/", -1).alias("file"), "content")
    listed = manifest.select("file", "first")
    small = manifest.count() <= common.BROADCAST_ROWS
    rows = files.join(F.broadcast(listed) if small else listed, "file").select("first", "content")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(*batch.columns, strict=True):
                shard = Shard(content.as_buffer())
                for at in range(0, shard.n, READ_DOCS):
                    count = min(READ_DOCS, shard.n - at)
                    bounds = shard.bounds.run(at, count + 1).astype("i8")
                    wide = shard.ids[bounds[0] : bounds[-1]].astype("<u4")
                    edges = (bounds - bounds[0]).tolist()
                    sums = [zlib.crc32(wide[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(at, count), pa.int64()), pa.array(bounds[:-1] + first.as_py()), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(take, f"{id_col} long, start long, n_tokens long, ids_crc32 long")
