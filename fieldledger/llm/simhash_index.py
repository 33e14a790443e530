"""Near-duplicates by SimHash over an inverted index of byte positions with a count filter.

The eight bytes of a fingerprint, each with its position, are the terms of the index. Fingerprints
that differ in at most k bits differ in at most k bytes, so a pair has to share 8 - k positional
bytes. Tallies over the lists of single bytes would meet every 64th of all pairs; here the lists of
every 8 - k positions are intersected beforehand: a term is the bytes at such a choice of positions,
and two fingerprints meet under a term exactly if their tally over its positions is full. A
pair is retained if it meets at all, under 1, 7 or 28 of the 28 terms for six, seven or eight shared
bytes, and is then verified by its differing bits. Fingerprints that meet under a term differ in k
bytes only, which bounds a list by 65,536 different ones for k = 2 and lets verification look up the
neighbours of each in place of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from fieldledger.llm.common import arrow_slices, merge_labels, stored

SHINGLE = 3
SEED = 42
BITS, BYTES = 64, 8
#: Fingerprints link at so many differing bits or fewer.
DISTANCE = 2
_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of ``sizes`` hashes: a bit is set if it is in over half of
    them. A run of no hashes gives 0."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    # A lane of eight bits counts up to 255 hashes, so runs are added up in blocks of that size.
    own, starts = sizes[filled], np.cumsum(sizes[filled]) - sizes[filled]
    blocks = -(-own // 255)
    first = np.cumsum(blocks) - blocks
    within = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    cuts = np.repeat(starts, blocks) + 255 * within
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts)
        for lane in range(8):
            counts = np.add.reduceat((lanes >> np.uint64(8 * lane)).astype(np.int64) & 255, first)
            out[filled] |= (2 * counts > own).astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def fingerprint_texts(texts: Iterable[str | None]) -> np.ndarray:
    """Fingerprints of whole texts: ASCII letters in lower case, words parted by spaces and control
    characters 9 to 13, shingles of three words (a shorter text is one shingle), each with its repeats."""
    hashes, sizes = [], []
    for text in texts:
        words = (text or "").encode().lower().split()
        size = min(SHINGLE, len(words))
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if size else ()
        sizes.append(max(0, len(words) - size + 1) if size else 0)
        hashes.append(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=sizes[-1]))
    return majority_bits(np.concatenate([np.empty(0, np.uint64), *hashes]), np.array(sizes, dtype=np.int64))


def _fingerprint_batches(schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches):
            found = fingerprint_texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], schema=schema)

    return run


def fingerprints(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, of every row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col("text").cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("fp", pa.int64())])
    return rows.mapInArrow(_fingerprint_batches(schema), f"doc_id {id_type.simpleString()}, fp long")


def byte_terms(fp: Column, distance: int = DISTANCE) -> Column:
    """The terms of a fingerprint: for each choice of positions that a pair has to share, its number
    and the bytes there."""
    terms = []
    for number, free in enumerate(combinations(range(BYTES), distance)):
        mask = (1 << BITS) - 1
        for byte in free:
            mask &= ~(255 << (8 * byte))
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        terms.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bytes")))
    return F.array(*terms)


def _flips(distance: int) -> np.ndarray:
    """All numbers of 1 to ``distance`` set bits in the free bytes."""
    width = 8 * distance
    return np.array([sum(1 << b for b in c) for k in range(1, distance + 1) for c in combinations(range(width), k)])


def nearest_links(fps: np.ndarray, free: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Links (higher, lower) that join the fingerprints of one list into its classes. They differ
    in the free bytes only. Each looks up the numbers within the distance and takes the lowest one
    that is present, until nothing gets lower."""
    fps = np.unique(fps.view(np.uint64))
    short = np.zeros(len(fps), dtype=np.int64)
    for i, byte in enumerate(free):
        short |= ((fps >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64) << (8 * i)
    place = np.full(1 << (8 * len(free)), -1, dtype=np.int32)
    place[short] = np.arange(len(fps))
    pairs_a, pairs_b = [], []
    for flip in _flips(len(free)):
        other = place[short ^ flip]
        lower = np.flatnonzero((other >= 0) & (other < np.arange(len(fps))))
        pairs_a.append(lower)
        pairs_b.append(other[lower].astype(np.int64))
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    label = np.arange(len(fps))
    while True:
        low = label.copy()
        np.minimum.at(low, label[a], label[b])
        np.minimum.at(low, label[b], label[a])
        while not np.array_equal(low, low[low]):
            low = low[low]
        joined = low[label]
        if np.array_equal(joined, label):
            break
        label = joined
    linked = np.flatnonzero(label < np.arange(len(fps)))
    return fps[linked].view(np.int64), fps[label[linked]].view(np.int64)


def _link_batches(distance: int) -> Callable:
    choices = list(combinations(range(BYTES), distance))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for i, choice in enumerate(batch.column(0).to_pylist()):
                a, b = nearest_links(lists[i].values.to_numpy(zero_copy_only=False), choices[choice])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between the different fingerprints of column fp, enough to join everything that
    pairs within the distance join. A link's ends are of one class, b being the lowest of its list."""
    if not 1 <= distance <= 2:
        raise ValueError("distance must be 1 or 2, so that a list stays within 65,536 fingerprints")
    terms = distinct.select("fp", F.explode(byte_terms(F.col("fp"), distance)).alias("t"))
    lists = terms.groupBy("t").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return lists.select(F.col("t.choice").alias("choice"), "fps").mapInArrow(_link_batches(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """One row per document: id, fp (fingerprint as a signed number), component_id.

    component_id is the smallest id that links reach, the own one included. Texts without words,
    null and empty among them, have fingerprint 0 and link like any other. Rows with a null id take
    part; if nothing they reach has an id, component_id is null. Rows with the same id stay rows of
    their own. Other columns are not read.
    """
    rows = stored(fingerprints(docs, id_column), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    found = stored(links(distinct.select("fp"), distance).distinct(), "links")
    ends = found.select(F.col("a").alias("rid")).unionByName(found.select(F.col("b").alias("rid"))).distinct()
    labels = merge_labels(stored(ends.withColumn("label", F.col("rid")), "labels"), found)
    # A fingerprint without links is its own class.
    named = stored(
        distinct.join(labels, distinct["fp"] == labels["rid"], "left").select(
            "fp", "low", F.coalesce("label", "fp").alias("label")
        ),
        "named",
    )
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    components = stored(named.join(lowest, "label").select("fp", "component_id"), "components")
    return rows.join(components, "fp").select(F.col("doc_id").alias(id_column), "fp", "component_id")
