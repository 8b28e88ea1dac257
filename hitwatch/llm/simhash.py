"""SimHash near-duplicates with pivot distance tables.

Fingerprints are the bitwise majority of the XXH64 hashes of a text's word shingles. Equal fingerprints are
merged first; two different ones can only link at ``near`` = 3 or fewer differing bits if they agree on three
of six blocks of bits, so each goes to the twenty keys of its block triples. Within a key, every fingerprint has a row of
precomputed Hamming distances to the reference fingerprints; pairs whose rows differ by more than ``near``
anywhere are discarded (triangle inequality), the survivors are verified by their exact distance, and only a
spanning forest of the links leaves the task. Keys are counted first, on the map side where they repeat; those held by very many
fingerprints are dealt in tiles from the start, each pair of a key's chunks in a tile of its own, so no exchange gathers a hot key.
A key of n fingerprints costs n * n / 2 comparisons of pivot rows in about (n / 2048)^2 / 2 tiles.

Defined cases: a null or blank text has fingerprint zero, linked like any other; texts with fewer words than
a shingle hash their whole word sequence; repeated rows keep one row each; rows with a null id take part,
and a component's id is the smallest non-null one. An empty table gives an empty result. Columns of any name may stand beside id and text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from hitwatch.functions.names import fresh
from hitwatch.llm import common
from hitwatch.llm.components import components

BITS = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bit ranges of the six blocks; 3 differing bits leave at least three of them untouched.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
AGREE = 3
#: A key with more fingerprints than this is dealt in tiles of two chunks of about as many.
TILE = 2048
#: Pairs looked at together in one task.
PAIRS = 1 << 20


def fingerprint(text: str | None, words: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """64-bit SimHash of a whole text; a bit is set if it is in more than half of the shingles' hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones = np.zeros(BITS, "i8")
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, block):
        part = found[start : min(n, start + block) + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
        hashes = np.array([digest(s, seed) for s in shingles], dtype=">u8")
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1).sum(0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(text_col: str = "text", words: int = 3) -> Column:
    """Column of fingerprints as signed 64-bit integers."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts.tolist()], "u8").view("i8"))

    return simhash(F.col(text_col))


def hex16(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def pivots(n: int = 24) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype="u8", endpoint=False)


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Table of Hamming distances, a row for each reference fingerprint."""
    return np.bitwise_count(prints[None, :] ^ references[:, None]).astype("i1")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join what the given links join: from each node to the least one of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _links(run: np.ndarray, side: np.ndarray, prints: np.ndarray, near: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links within runs of equal ``run`` (sorted): between rows of different sides, and of side -1 throughout.

    All runs advance together: step s pairs each row with the one s places after it, while that is in its run.
    """
    table = distances(prints, references)
    ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, len(run))
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(run)) - 1  # rows after each in its run
    found_a, found_b = [np.zeros(0, prints.dtype)], [np.zeros(0, prints.dtype)]
    rows, held = np.flatnonzero(left > 0), 0
    s = 1
    while len(rows):
        for i in range(0, len(rows), PAIRS):
            a = rows[i : i + PAIRS]
            b = a + s
            across = (side[a] != side[b]) | (side[a] < 0)
            a, b = a[across], b[across]
            for row in table:
                keep = np.abs(row[a] - row[b]) <= near
                a, b = a[keep], b[keep]
                if not len(a):
                    break
            if len(a):
                gap = np.bitwise_count(prints[a] ^ prints[b])
                close = (gap <= near) & (gap > 0)
                found_a.append(prints[a[close]])
                found_b.append(prints[b[close]])
                held += int(close.sum())
        if held > PAIRS:
            x, y = _forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [x], [y], 0
        s += 1
        rows = rows[left[rows] >= s]
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def _linker(near: int):
    """Function for mapInArrow over rows (run, side, fp) sorted by run: the links within each run."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots()
        carry = [np.zeros(0, "i8")] * 3

        def settle(run, side, prints):
            if len(run):
                u, v = _links(run, side, prints.view("u8"), near, references)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view("i8")), pa.array(v.view("i8"))], schema=out)

        for batch in batches:
            run, side, prints = (np.concatenate([c, n.to_numpy()]) for c, n in zip(carry, batch.columns, strict=True))
            if not len(run):
                continue
            last = int(np.searchsorted(run, run[-1]))  # the last run may go on in the next batch
            yield from settle(run[:last], side[:last], prints[:last])
            carry = [run[last:], side[last:], prints[last:]]
        yield from settle(*carry)

    return work


def _dealt(nodes: DataFrame) -> DataFrame:
    """Rows (run, side, fp): each fingerprint under its keys, those of hot keys under the tiles that their chunk takes part in."""
    keys = []
    for number, chosen in enumerate(combinations(BLOCKS, AGREE)):
        key = F.lit(number)
        for start, width in chosen:
            key = F.shiftleft(key.cast("long"), width).bitwiseOR(F.shiftrightunsigned("fp", start).bitwiseAND((1 << width) - 1))
        keys.append(key)
    keyed = nodes.select("fp", F.explode(F.array(*keys)).alias("run"))
    sizes = common.Stored(keyed.groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select(F.col("run").alias("hot"), F.ceil(F.col("n") / TILE).cast("long").alias("n")), "hot").df
    small = sizes.count() <= common.BROADCAST_ROWS
    marked = keyed.join(F.broadcast(sizes) if small else sizes, F.col("run") == F.col("hot"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("n"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda other: F.struct(F.xxhash64("run", F.least(own, other), F.greatest(own, other)).alias("run"), F.when(own == other, F.lit(-1).cast("long")).otherwise(own).alias("side")))
    whole = F.array(F.struct(F.col("run"), F.lit(-1).cast("long").alias("side")))
    return marked.select("fp", F.inline(F.when(F.col("n").isNull(), whole).otherwise(tiles))).select("run", "side", "fp")


def links(nodes: DataFrame, near: int = 3) -> DataFrame:
    """Rows (u, v): links that join whatever fingerprints (``fp``, distinct) are chained by ``near`` or fewer differing bits."""
    if near > len(BLOCKS) - AGREE:
        raise ValueError(f"near must be at most {len(BLOCKS) - AGREE}")
    return _dealt(nodes).repartition("run").sortWithinPartitions("run").mapInArrow(_linker(near), "u long, v long")


def _rooted(prints: DataFrame, owner: Column, near: int) -> DataFrame:
    """(fp, root, owner, n): the component of each fingerprint, the least ``owner`` of its rows and their number."""
    nodes = common.Stored(prints.groupBy("fp").agg(F.min(owner).alias("owner"), F.count("*").alias("n")), "nodes").df
    roots = components(links(nodes.select("fp"), near))
    return common.Stored(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted").df


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, near: int = 3) -> DataFrame:
    """A row (id, fingerprint, component_id) for each row of ``docs``."""
    prints = common.Stored(docs.select(F.col(id_col).alias("_id"), fingerprints(text_col, words).alias("fp")), "fingerprints").df
    rooted = _rooted(prints, F.col("_id"), near)
    owners = rooted.groupBy("root").agg(F.min("owner").alias("component_id"))
    member = rooted.join(owners, "root").select("fp", "component_id")
    return prints.join(member, "fp").select(F.col("_id").alias(id_col), hex16("fp").alias("fingerprint"), "component_id")


def _row_keys(docs: DataFrame, names: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a whole row, null flags included; rows that agree in both count as the same row."""
    cells = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        cells += [c.isNull(), F.to_json(F.struct(c)) if isinstance(f.dataType, ArrayType | MapType | StructType) else c]
    return [F.xxhash64(F.lit(i), *cells).alias(name) for i, name in enumerate(names)]


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, near: int = 3, repeats: bool = True) -> DataFrame:
    """``docs`` without the rows that are not the first of their component, judged row by row, not by id alone.

    With ``repeats``, all rows with a component's smallest id stay, and all rows of a component without any
    non-null id. Without, exactly one row of each component stays: the one with the smallest id, nulls last, and
    of those the one with the least hashes of the whole row.
    """
    keys = fresh([*docs.columns, "_id", "fp", "first", "stays", "n", "root", "owner"], "_hw_0", "_hw_1")
    prints = common.Stored(docs.select(F.col(id_col).alias("_id"), fingerprints(text_col, words).alias("fp"), *_row_keys(docs, keys)), "fingerprints").df
    rooted = _rooted(prints, F.struct(F.col("_id").isNull().alias("none"), "_id", *keys), near)
    owners = rooted.groupBy("root").agg(F.min("owner").alias("first"), F.sum("n").alias("rows")).filter("rows > 1")
    member = rooted.join(owners, "root").select("fp", "first")
    stays = F.col("_id").eqNullSafe(F.col("first._id")) if repeats else (F.col(keys[0]) == F.col("first")[keys[0]]) & (F.col(keys[1]) == F.col("first")[keys[1]])
    counted = prints.join(member, "fp").groupBy(*keys, stays.alias("stays")).agg(F.count("*").alias("n"))
    marked = common.Stored(counted.filter("NOT stays" if repeats else "NOT stays OR n > 1"), "duplicates").df
    small = marked.count() <= common.BROADCAST_ROWS
    side = lambda rows: F.broadcast(rows.select(*keys)) if small else rows.select(*keys)
    keyed = docs.select("*", *_row_keys(docs, keys))
    copied = marked.filter("stays")
    if repeats or not copied.limit(1).count():
        return keyed.join(side(marked), keys, "left_anti").drop(*keys)
    # of rows that are alike in all columns any one will do
    once = keyed.join(side(copied), keys, "left_semi").dropDuplicates(keys)
    return keyed.join(side(marked), keys, "left_anti").unionByName(once).drop(*keys)
