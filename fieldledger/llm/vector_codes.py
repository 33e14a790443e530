"""Vector codes by product quantisation over per-dimension value dictionaries.

Vectors become integers and are kept in blocks. For each dimension a block holds the dictionary of
its distinct integers, and every vector's number in it. To compare a part of all vectors of a block
with all entries of a codebook, the squared differences of every dictionary value to every entry are
tabulated once per dimension; the distances of a part are then gathers from these tables and adds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldledger.llm.common import stored

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors in a block at most, and vectors whose distances are gathered at a time.
BLOCK, CHUNK = 4096, 512


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def integers(values: np.ndarray, dimensions: int) -> np.ndarray:
    """Floor of SCALE times each value. Beyond a bound at which the squared error of a whole vector
    might not fit 64 bits (2**27 for 64 dimensions, values of 131,072) integers saturate."""
    bound = 2 ** ((62 - max(1, dimensions - 1).bit_length()) // 2 - 1)
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -bound, bound).astype(np.int64)


def part_bounds(dimensions: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts; equal ones where the number of dimensions allows."""
    cuts = [dimensions * k // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _block_batches(dimensions: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                rows = piece.num_rows
                flat = piece.column(2).flatten().to_numpy(zero_copy_only=False)
                columns = integers(flat, dimensions).reshape(rows, dimensions).T
                found = [np.unique(c, return_inverse=True) for c in columns]
                codes = b"".join(code.astype(np.uint16).tobytes() for _, code in found)
                values = np.concatenate([np.empty(0, np.int64), *(v for v, _ in found)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), piece.column(0)),
                        pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), piece.column(1)),
                        pa.array([[len(v) for v, _ in found]], pa.list_(pa.int32())),
                        pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values)),
                        pa.array([codes], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def nearest(dictionaries: list[np.ndarray], codes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower one) and squared distance of each vector part, given by its
    dictionaries and codes (dimensions x vectors)."""
    rows = codes.shape[1]
    index, distance = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    if not len(dictionaries):
        return index, distance
    tables = [(values[:, None] - entries[None, :, d]) ** 2 for d, values in enumerate(dictionaries)]
    if sum(int(t.max()) for t in tables) < 2**31:
        tables = [t.astype(np.int32) for t in tables]
    gathered = np.empty((CHUNK, entries.shape[0]), dtype=tables[0].dtype)
    total = np.empty_like(gathered)
    for lo in range(0, rows, CHUNK):
        hi = min(rows, lo + CHUNK)
        acc, part = total[: hi - lo], gathered[: hi - lo]
        np.take(tables[0], codes[0, lo:hi], axis=0, out=acc, mode="clip")
        for d in range(1, len(tables)):
            np.take(tables[d], codes[d, lo:hi], axis=0, out=part, mode="clip")
            acc += part
        index[lo:hi] = acc.argmin(axis=1)
        distance[lo:hi] = acc[np.arange(hi - lo), index[lo:hi]]
    return index, distance


def _open_block(batch: pa.RecordBatch, row: int, dimensions: int) -> tuple[list[np.ndarray], np.ndarray]:
    sizes = batch.column(2)[row].values.to_numpy(zero_copy_only=False)
    values = batch.column(3)[row].values.to_numpy(zero_copy_only=False)
    rows = len(batch.column(0)[row])
    codes = np.frombuffer(batch.column(4)[row].as_py(), dtype=np.uint16).reshape(dimensions, rows)
    return np.split(values, np.cumsum(sizes)[:-1]) if dimensions else [], codes


def _sum_batches(codebooks: list[np.ndarray], dimensions: int, width: int) -> Callable:
    """Sums of the parts that each entry is nearest to; one set of rows per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = part_bounds(dimensions, len(codebooks))
        entries = len(codebooks[0])
        counts = np.zeros((len(codebooks), entries), dtype=np.int64)
        sums = np.zeros((len(codebooks), entries, width), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                dictionaries, codes = _open_block(batch, row, dimensions)
                for part, (lo, hi) in enumerate(bounds):
                    index, _ = nearest(dictionaries[lo:hi], codes[lo:hi], codebooks[part])
                    counts[part] += np.bincount(index, minlength=entries)
                    for d in range(lo, hi):  # below 2**53, so the weights are exact
                        added = np.bincount(index, weights=dictionaries[d][codes[d]], minlength=entries)
                        sums[part, :, d - lo] += added.astype(np.int64)
        part, entry = np.nonzero(counts)
        columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry], *sums[part, entry].T]
        names = ["part", "entry", "n", *(f"s{k}" for k in range(width))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _code_batches(codebooks: list[np.ndarray], dimensions: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = part_bounds(dimensions, len(codebooks))
        digits = np.array([f"{k:02x}" for k in range(256)])
        for batch in batches:
            for row in range(batch.num_rows):
                dictionaries, codes = _open_block(batch, row, dimensions)
                found = [
                    nearest(dictionaries[lo:hi], codes[lo:hi], book)
                    for (lo, hi), book in zip(bounds, codebooks, strict=True)
                ]
                code = digits[found[0][0]]
                for index, _ in found[1:]:
                    code = np.char.add(code, digits[index])
                error = np.sum([d for _, d in found], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row].values, batch.column(1)[row].values, pa.array(code), pa.array(error)],
                    schema=schema,
                )

    return run


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def fit_codebooks(
    blocks: DataFrame, codebooks: list[np.ndarray], dimensions: int, rounds: int = ROUNDS
) -> list[np.ndarray]:
    """Codebooks after ``rounds`` of assigning every part and moving each used entry to the floor of
    its parts' mean. A round is one pass; the driver takes one row per used entry."""
    bounds = part_bounds(dimensions, len(codebooks))
    width = max((hi - lo for lo, hi in bounds), default=0)
    schema = ", ".join(["part int", "entry int", "n long", *(f"s{k} long" for k in range(width))])
    for _ in range(rounds):
        partial = blocks.mapInArrow(_sum_batches(codebooks, dimensions, width), schema)
        sums = partial.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in partial.columns[2:])).collect()
        codebooks = [book.copy() for book in codebooks]
        for row in sums:
            lo, hi = bounds[row.part]
            codebooks[row.part][row.entry] = [row[3 + k] // row.n for k in range(hi - lo)]
    return codebooks


def encode(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes (id, label, code, error) of all kept vectors, and the codebooks.

    Rows whose vector is null or holds a null or non-finite component are dropped. So are those
    whose length is not that of the kept vector of the smallest id. Each codebook starts as the
    parts of the kept vectors of the smallest ids (null ids last, equal ids by their vector). With
    fewer vectors than entries the codebooks are that short; with none there are no rows. A code has
    two hexadecimal digits per part; error is the squared distance to the entries. Rows with equal
    ids or a null id or label stay rows of their own. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector"))
    kept = rows.filter(finite(F.col("vector")))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    dimensions = len(first[0].vector) if first else 0
    same = [r.vector for r in first if len(r.vector) == dimensions]
    if len(same) < len(first):  # other lengths among them: choose again
        kept = kept.filter(F.size("vector") == dimensions)
        same = [r.vector for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    kept = kept.filter(F.size("vector") == dimensions)
    start = integers(np.array(same, dtype=np.float64).reshape(len(same), dimensions), dimensions)
    codebooks = [start[:, lo:hi] for lo, hi in part_bounds(dimensions, parts)]
    types = [rows.schema[c].dataType for c in ("vec_id", "label")]
    id_type, label_type = (to_arrow_type(t) for t in types)
    block_schema = pa.schema(
        [
            ("vec_id", pa.list_(id_type)),
            ("label", pa.list_(label_type)),
            ("sizes", pa.list_(pa.int32())),
            ("dictionary", pa.list_(pa.int64())),
            ("codes", pa.binary()),
        ]
    )
    blocks = stored(
        kept.mapInArrow(
            _block_batches(dimensions, block_schema),
            f"vec_id array<{types[0].simpleString()}>, label array<{types[1].simpleString()}>, sizes array<int>, dictionary array<long>, codes binary",
        ),
        "blocks",
    )
    codebooks = fit_codebooks(blocks, codebooks, dimensions, rounds)
    schema = pa.schema([("vec_id", id_type), ("label", label_type), ("code", pa.string()), ("error", pa.int64())])
    coded = blocks.mapInArrow(
        _code_batches(codebooks, dimensions, schema),
        f"vec_id {types[0].simpleString()}, label {types[1].simpleString()}, code string, error long",
    )
    return coded, codebooks


def with_label_error(coded: DataFrame) -> DataFrame:
    """The codes with label_error, the error summed over the rows of one label (nulls together;
    null where the sum exceeds 64 bits)."""
    coded = stored(coded, "codes")
    totals = stored(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    totals = totals.withColumnRenamed("label", "__label")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label")
