"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 characters cuts each text into chunks whose borders depend on content alone,
so passages that documents share become equal chunks; a task encodes each distinct chunk once and keeps it.
Chunks joined end to end may tokenise differently around the cut. A window around it is encoded anew: from the last-but-one
certain word border before it to the second one after it, and from one border further out on either side each time its outer words
do not agree exactly with what the two chunks have there; a text whose borders run out is encoded in one piece. A border is certain
between a character and a single space that are both followed by non-space: the pre-tokeniser always splits there. Chunks without
enough such borders grow by their neighbours; a text that has none over ``MOST`` characters is encoded in one piece.

Runs with special tokens, or with characters outside blocks whose classes are fixed in every Unicode version, are cut out at certain
borders, a word away from them on either side, and encoded by the tokenizers library; the text around them goes by chunks. Chunks go
through the same vocabulary as merge ranks.

"Once" holds for a task. Sharing chunks among tasks was weighed and left out: of the 173 MB of chunks of ``check_s`` 10 % repeat, 4 % within tasks already, and
to find the other 6 % takes a pass over all texts and an exchange of their chunks' hashes, which costs more than encoding them again.

Defined cases: a null text counts as empty and has no tokens; decoding null ids gives null; repeated rows
are encoded alike; other columns are not touched. The chunk memo is bounded (``MEMO_BYTES`` a worker), and
a chunk that fell out of it is encoded again.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WINDOW, AVERAGE, LEAST, MOST = 16, 1024, 256, 16_384
MEMO_BYTES = 48 << 20
#: Certain borders that a window can take in on either side.
BORDERS = 8
BLOCK = 1 << 20
#: Fixed value: how the byte-level pre-tokeniser splits a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters outside blocks that all Unicode versions in use class alike: Latin, Greek, Cyrillic, general punctuation, kana, CJK, Hangul.
UNSETTLED = re.compile("[^\x00-ɏΑ-ΡΣ-ώА-я‐-‧€ぁ-ゖァ-ヺ一-龥가-힣]")


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cuts(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text."""
    found = []
    for at in range(0, len(text), BLOCK):
        begin = max(0, at - WINDOW + 1)
        h = np.frombuffer(text[begin : at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        if len(h) < WINDOW:
            continue
        step, factor = 1, 0x08088405
        while step < WINDOW:  # hashes of 1, 2, 4, 8, 16 characters
            h = h[:-step] * np.uint32(factor) + h[step:]
            factor, step = factor * factor & 0xFFFFFFFF, 2 * step
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x9E3779B1)
        found += (np.flatnonzero(h < np.uint32(0xFFFFFFFF // AVERAGE)) + begin + WINDOW).tolist()
    ends, last = [], 0
    for end in found:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST and len(text) - end >= LEAST:
            ends.append(end)
            last = end
    while len(text) - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, len(text)]


class Chunk:
    """Ids of a piece of text, and its outermost certain borders at either end as (characters, tokens): two, and more where a window needs them."""

    __slots__ = ("head", "ids", "kept", "tail", "text")

    def __init__(self, text: str, ids: array, sizes: list[int]) -> None:
        self.text, self.ids, self.kept = text, ids, 0
        self.borders(sizes, 2)

    def borders(self, sizes: list[int], most: int) -> None:
        """Find up to ``most`` borders at either end."""
        if most <= self.kept:
            return
        text, ids, self.kept, self.head, self.tail = self.text, self.ids, most, [], []
        at = tokens = done = 0
        while len(self.head) < most and (at := text.find(" ", at + 1)) > 0:
            if certain(text, at):
                size = len(text[:at].encode())
                while done < size:
                    done += sizes[ids[tokens]]
                    tokens += 1
                self.head.append((at, tokens))
        at, tokens, left = len(text), len(ids), 0
        while len(self.tail) < most and (at := text.rfind(" ", 1, at)) > 0:
            if certain(text, at):
                size = len(text[at:].encode())
                while left < size:
                    tokens -= 1
                    left += sizes[ids[tokens]]
                self.tail.append((at, tokens))

    @property
    def joins(self) -> bool:
        return min(len(self.head), len(self.tail)) > 1 and self.head[1][0] < self.tail[1][0]

    def reach(self, other: Chunk) -> int:
        """How many borders a window between this chunk and the next can take in on either side: none beyond a chunk's middle, so windows of a chunk never meet."""
        mine = sum(self.tail[i][0] > self.head[i][0] for i in range(min(len(self.head), len(self.tail))))
        theirs = sum(other.tail[i][0] > other.head[i][0] for i in range(min(len(other.head), len(other.tail))))
        return min(mine, theirs)


def certain(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and not text[at - 1].isspace() and not text[at + 1].isspace()


def border_before(text: str, at: int, least: int) -> int:
    """The second certain border before a place, or ``least`` where there is none after it."""
    for _ in range(2):
        at = text.rfind(" ", least, at)
        while at > least and not certain(text, at):
            at = text.rfind(" ", least, at)
        if at <= least:
            return least
    return at


def border_after(text: str, at: int) -> int:
    """The second certain border from a place on, or the text's end."""
    at -= 1
    for _ in range(2):
        at = text.find(" ", at + 1)
        while at >= 0 and not certain(text, at):
            at = text.find(" ", at + 1)
        if at < 0:
            return len(text)
    return at


class Codec:
    """Encoder and decoder of one worker for one tokenizer file."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        parts = json.loads(self.library.to_str())
        pre = parts.get("pre_tokenizer") or {}
        self.specials = [t["content"] for t in parts.get("added_tokens", [])]
        letters = byte_letters()
        size = self.library.get_vocab_size()
        special = set(self.specials)
        tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        self.bytes = [t.encode() if t in special else bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        self.sizes = [len(b) for b in self.bytes]
        self.by_chunks = parts.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not parts.get("post_processor") and (parts.get("decoder") or {}).get("type") == "ByteLevel"
        if self.by_chunks:
            ranks = {b: i for i, (b, t) in enumerate(zip(self.bytes, tokens, strict=True)) if t not in special}
            self.ranked = tiktoken.Encoding("chunks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        # special tokens that hold spaces could reach over a certain border: then all of a text goes to the library
        self.by_chunks = self.by_chunks and not any(" " in t for t in self.specials)
        self.odd = re.compile("|".join([f"{UNSETTLED.pattern}+", *map(re.escape, self.specials)]))
        self.memo: dict[str, Chunk] = {}
        self.held = 0
        self.made = self.reused = 0

    def chunk(self, text: str) -> Chunk:
        found = self.memo.get(text)
        if found is not None:
            self.reused += 1
            return found
        self.made += 1
        new = Chunk(text, array("I", self.ranked.encode_ordinary(text)), self.sizes)
        self.memo[text] = new
        self.held += 2 * len(text) + 4 * len(new.ids) + 600
        while self.held > MEMO_BYTES and len(self.memo) > 1:  # the oldest go
            old = self.memo.pop(next(iter(self.memo)))
            self.held -= 2 * len(old.text) + 4 * len(old.ids) + 600
        return new

    def seam(self, a: Chunk, b: Chunk, i: int) -> array | None:
        """Ids between border number ``i`` before a join and that after it, if their outer words agree with those of the chunks."""
        (near_a, far_a), (near_b, far_b) = a.tail[i - 1 : i + 1], b.head[i - 1 : i + 1]
        ids = array("I", self.ranked.encode_ordinary(a.text[far_a[0] :] + b.text[: far_b[0]]))
        left, right = a.ids[far_a[1] : near_a[1]], b.ids[near_b[1] : far_b[1]]
        return ids if len(ids) >= len(left) + len(right) and ids[: len(left)] == left and ids[len(ids) - len(right) :] == right else None

    def window(self, a: Chunk, b: Chunk) -> tuple[int, array] | None:
        """How many borders out on either side a window's outer words agree with the chunks, and the ids between those borders."""
        ids = self.seam(a, b, 1)
        if ids is not None:
            return 1, ids
        for c in (a, b):
            c.borders(self.sizes, BORDERS)
        for i in range(2, a.reach(b)):
            ids = self.seam(a, b, i)
            if ids is not None:
                return i, ids
        return None

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in pieces cut at certain borders, and whether a piece holds special tokens or unsettled characters."""
        odd = [m.span() for m in self.odd.finditer(text)]
        at = 0
        for first, last in odd:
            if last <= at:
                continue  # lies in the piece before
            begin, end = border_before(text, first, at), border_after(text, last)
            if at < begin:
                yield text[at:begin], False
            yield text[begin:end], True
            at = end
        if at < len(text):
            yield text[at:], False

    def encode(self, text: str | None) -> array:
        text = text or ""
        if not self.by_chunks:
            return array("I", self.library.encode(text, add_special_tokens=False).ids)
        if not UNSETTLED.search(text) and not any(t in text for t in self.specials):
            return self.by_reuse(text)
        out = array("I")
        for piece, is_odd in self.pieces(text):
            out.extend(self.library.encode(piece, add_special_tokens=False).ids if is_odd else self.by_reuse(piece))
        return out

    def by_reuse(self, text: str) -> array:
        """Ids of a text without special tokens or unsettled characters, by chunks."""
        if not text:
            return array("I")
        parts: list[Chunk] = []
        start, ends = 0, cuts(text)
        for end in ends:
            part = self.chunk(text[start:end])
            if part.joins or end == len(text):
                parts.append(part)
                start = end
            elif end - start > MOST:  # as in scripts without spaces: growing on would encode the same text over and over
                return array("I", self.ranked.encode_ordinary(text))
        while len(parts) > 1 and not parts[-1].joins:
            last = parts.pop()
            parts[-1] = self.chunk(parts[-1].text + last.text)
        if len(parts) == 1:
            return parts[0].ids
        out, at = array("I"), 0
        for a, b in zip(parts, parts[1:], strict=False):
            seam = self.window(a, b)
            if seam is None:  # no agreement: the text is encoded in one piece
                return array("I", self.ranked.encode_ordinary(text))
            out.extend(a.ids[at : a.tail[seam[0]][1]])
            out.extend(seam[1])
            at = b.head[seam[0]][1]
        out.extend(parts[-1].ids[at:])
        return out

    def decode(self, ids: list[int]) -> str:
        if not self.by_chunks:
            return self.library.decode(ids, skip_special_tokens=False)
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def id_lists(ids: list[array]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype="i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(i.tobytes() for i in ids), "<u4").view("<i4")))


def encoder(path: str, text_col: str = "text") -> Column:
    """Column of token ids (array of int) of a text column; ``path`` is the tokenizer's file, found on every executor."""

    @F.arrow_udf("array<int>")
    def bpe_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for texts in batches:
            yield id_lists([own.encode(t.as_py()) for t in texts])

    return bpe_encode(F.col(text_col))


def decoder(path: str, ids_col: str = "ids") -> Column:
    """Column of texts of a column of token ids."""

    @F.arrow_udf("string")
    def bpe_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for ids in batches:
            yield pa.array([own.decode(i.values.to_numpy().tolist()) if i.is_valid else None for i in ids], pa.string())

    return bpe_decode(F.col(ids_col))


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """Rows (id, ids, decoded) for all rows of ``docs``, handed on in small batches so that a worker's memory stays low."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids, decoded, first, held = [], [], 0, 0
            for row, text in enumerate(batch.column(1), 1):
                ids.append(own.encode(text.as_py()))
                decoded.append(own.decode(ids[-1]))
                held += 4 * len(ids[-1]) + len(decoded[-1])
                if held >= batch_bytes or row == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, row - first), id_lists(ids), pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])
                    ids, decoded, first, held = [], [], row, 0

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(work, StructType([rows.schema[0], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]))


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and SHA-256 of ids (decimal, joined by commas) and of the decoded text."""
    return coded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
