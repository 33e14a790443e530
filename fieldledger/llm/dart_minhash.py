"""Near-duplicate classes by DartMinHash.

A weighted set is a region of (element, weight) points. A fixed random process throws darts, each
with a rank, at every element; a set keeps the darts inside its region, each dart belongs to one
of K coordinates, and the dart of lowest rank at each coordinate makes the signature. Two sets
agree at a coordinate with the probability of their weighted Jaccard similarity. Only cells of low
rank are thrown, so a signature takes about K ln K darts, however many elements the set has.
Bands of the signature are joined, and candidate pairs are verified on their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import merge_labels, mix64, stored, text_slices
from fieldledger.llm.spaced_seeds import tokens_of

SHINGLE = 5
THRESHOLD = 0.8
#: At similarity 0.8 a pair shares no band with probability 5e-6, at 0.85 with 6e-9.
BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
#: Darts that each set expects at first; a coordinate that stays empty gets more ranks.
DARTS = COORDINATES * (np.log(COORDINATES) + 2)
#: Ranks below 2**LOWEST are one cell; above, each cell is twice as high as the one before.
LOWEST = -4
#: A task signs so many texts, or characters, at a time; each text has about DARTS darts.
SLICE_ROWS, SLICE_CHARS = 200, 500_000
#: Shingles are counted in so many groups to bound what two sets can have in common.
GROUPS = 32
#: Buckets are compared in blocks of about so many members, each block pair a row group of its own.
BLOCK = 1024


@cache
def poisson_steps(area: float) -> np.ndarray:
    """Cumulative probabilities of the number of darts in a cell."""
    n = np.arange(int(area + 12 * np.sqrt(area) + 24))
    logs = n * np.log(area) - area - np.concatenate([[0], np.cumsum(np.log(n[1:]))])
    return np.cumsum(np.exp(logs))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(owner, element, weight, low: float, high: float, cell: int, out: np.ndarray) -> None:
    """Darts with ranks from ``low`` to ``high``; lowers ``out[owner, coordinate]``."""
    floor, top, layer = 0.0, 1.0, 0
    while True:
        inside = weight > floor
        if not inside.any():
            return
        own, w = owner[inside], weight[inside]
        seed = mix64(element[inside] ^ np.uint64((cell * 1000 + layer + 1) * 0x9E3779B97F4A7C15 % 2**64))
        counts = np.searchsorted(poisson_steps((high - low) * (top - floor)), _unit(seed), side="right")
        total = int(counts.sum())
        if total:
            source = np.repeat(np.arange(len(seed)), counts)
            order = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            dart = mix64(seed[source] + (order + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            hit = mix64(dart ^ np.uint64(0xE7037ED1A0B428DB))
            if not (w >= top).all():
                height = floor + _unit(mix64(hit ^ np.uint64(0x8EBC6AF09C88C6E3))) * (top - floor)
                kept = height < w[source]
                source, dart, hit = source[kept], dart[kept], hit[kept]
            place = own[source] * COORDINATES + (hit % np.uint64(COORDINATES)).astype(np.int64)
            np.minimum.at(out.reshape(-1), place, low + _unit(dart) * (high - low))
        floor, top, layer = top, top * 2, layer + 1


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int) -> np.ndarray:
    """Lowest rank per set and coordinate (sets x COORDINATES) of weighted sets given as rows
    (owner, element hash, weight > 0). A set without elements has infinite ranks."""
    out = np.full((sets, COORDINATES), np.inf)
    total = np.bincount(owner, weights=weight, minlength=sets)
    reach = np.divide(DARTS, total, out=np.zeros(sets), where=total > 0)
    low, high, cell = 0.0, 2.0**LOWEST, 0
    while True:
        active = (total > 0) & ((low < reach) | np.isinf(out).any(axis=1))
        if not active.any():
            return out
        rows = active[owner]
        _throw(owner[rows], element[rows], weight[rows], low, high, cell, out)
        low, high, cell = high, high * 2, cell + 1


def band_keys(ranks: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; sets x BANDS."""
    ids = ranks.view(np.uint64).reshape(len(ranks), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(ranks), BANDS)).copy()
    for i in range(ROWS):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + ids[:, :, i])
    return out.view(np.int64)


def shingles_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a token row and how often each occurs. A row of fewer than
    SHINGLE tokens is one shingle; one without tokens has none."""
    n = len(tokens)
    if not n:
        return np.empty(0, dtype=np.uint64), np.empty(0)
    size = min(n, SHINGLE)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + tokens[i : n - size + 1 + i])
    values, counts = np.unique(out, return_counts=True)
    return values, counts.astype(float)


def _shortened(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit hashes of distinct shingles; the weights of hashes that fall together add up."""
    short, place = np.unique((values >> np.uint64(32)).astype(np.uint32).view(np.int32), return_inverse=True)
    return short, np.bincount(place, weights=weights, minlength=len(short)).astype(np.float32)


def _signature_batches(weighting: str) -> Callable:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in text_slices(batches, chars=SLICE_CHARS, rows=SLICE_ROWS):
            tokens, counts = tokens_of(rows.text)
            parts = np.split(tokens, np.cumsum(counts)[:-1])
            sets = [shingles_of(p) for p in parts]
            sizes = np.array([len(s) for s, _ in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            element = np.concatenate([s for s, _ in sets])
            weight = np.concatenate([w for _, w in sets]) if weighting == "count" else np.ones(len(element))
            keys = band_keys(signatures(owner, element, weight, len(sets)))
            short = [_shortened(s, w) for s, w in sets]
            totals = [float(len(s) if weighting != "count" else w.sum()) for s, w in short]
            yield pd.DataFrame(
                {
                    "doc_id": rows.doc_id.astype("Int64"),
                    "text_key": rows.text_key,
                    # Texts without a word are alike only if they are equal.
                    "digest": [
                        hashlib.md5(p.tobytes() if len(p) else b"\0" + t.encode()).hexdigest()
                        for p, t in zip(parts, rows.text, strict=True)
                    ],
                    "total": totals,
                    "shingles": [s for s, _ in short],
                    "weights": [w for _, w in short] if weighting == "count" else None,
                    "bands": [k if n else k[:0] for k, n in zip(keys, sizes, strict=True)],
                }
            )

    return run


def similarity(a: np.ndarray, b: np.ndarray, wa: np.ndarray | None = None, wb: np.ndarray | None = None) -> float:
    """Weighted Jaccard similarity of two sets of distinct values."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if wa is None or wb is None:
        return len(i) / (len(a) + len(b) - len(i))
    common = np.minimum(wa[i], wb[j]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


def _verify(threshold: float) -> Callable:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [
                similarity(r.sa, r.sb, r.wa, r.wb) >= threshold - 1e-9 for r in batch.itertuples(index=False)
            ]
            yield batch.loc[np.array(same, dtype=bool), ["a", "b"]]

    return run


def _link(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that reach the threshold, of pairs whose sizes allow it."""
    a = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    b = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    return stored(pairs.join(a, "a").join(b, "b").mapInPandas(_verify(threshold), "a long, b long"), "links")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with label and n (members of the bucket), of buckets with more than one class."""
    held = members.join(labels, "rid")
    keys = held.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return held.join(keys.filter("lo < hi").select("key", "n"), "key")


def _in_groups(weight: Column) -> list[Column]:
    """Sums of weight by group of the shingle."""
    group = F.pmod("shingle", F.lit(GROUPS))
    return [F.sum(F.when(group == g, weight).otherwise(0.0)).alias(f"g{g}") for g in range(GROUPS)]


def _shared_weight(held: DataFrame, sets: DataFrame) -> DataFrame:
    """rid, shared: for each open set the weight, by group, of the elements it shares with any other
    open set. Linear in their elements: all it has, less what it has to itself."""
    ones = F.transform("shingles", lambda _: F.lit(1.0).cast("float"))
    elements = F.arrays_zip("shingles", F.coalesce("weights", ones).alias("weights"))
    rows = stored(
        sets.join(held.select("rid").distinct(), "rid")
        .select("rid", F.explode(elements).alias("x"))
        .select("rid", F.col("x.shingles").alias("shingle"), F.col("x.weights").alias("w")),
        "elements",
    )
    alone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("rid").alias("rid"), F.min("w").alias("w")).filter("n = 1")
    signed = rows.unionByName(alone.select("rid", "shingle", (-F.col("w")).alias("w")))
    sums = signed.groupBy("rid").agg(*_in_groups(F.col("w")))
    return sums.select("rid", F.array(*(F.col(f"g{g}").cast("float") for g in range(GROUPS))).alias("shared"))


def _possible(common: Column, a: str, b: str, threshold: float) -> Column:
    """Whether two sets of totals a and b with at most ``common`` in both can reach the threshold."""
    return common >= threshold * (F.col(a) + F.col(b) - common) - F.lit(1e-3)


def _classes(sets: DataFrame, threshold: float) -> DataFrame:
    """rid, label of the sets that share a band with another; a label is the smallest rid of a class.

    First all members of a bucket are compared with a centre, the member that meets most others over
    all its buckets. That joins what is near one original. A bucket whose members are then of one
    class is done. In the others, members of different classes are held against each other by an
    upper bound of what they can have in common: the smaller of both sums, group by group of
    shingles, of what each shares with any open set. Only pairs that the bound lets through become
    rows, and these are compared shingle by shingle. So every pair that shares a band is linked,
    known to be dissimilar, or of one class; no pair is left out. Large buckets are dealt in blocks.
    """
    bands = sets.select("rid", "total", F.explode("bands").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(bands.join(sizes, "key"), "members")
    weight = members.groupBy("rid").agg(F.sum("n").alias("meets"))
    members = stored(members.join(weight, "rid").select("key", "rid", "total", "meets"), "members")
    labels = stored(members.select("rid", F.col("rid").alias("label")).distinct(), "labels")
    best = F.max(F.struct("meets", (-F.col("rid")).alias("r"), F.col("total").alias("t"))).alias("c")
    # Stored, so that the join below reads two shuffles and can split large buckets.
    centre = stored(
        members.groupBy("key").agg(best).select("key", (-F.col("c.r")).alias("b"), F.col("c.t").alias("other")), "centres"
    )
    met = members.join(centre, "key").filter(F.col("rid") != F.col("b"))
    stars = met.filter(_possible(F.least("total", "other"), "total", "other", threshold))
    pairs = stars.select(F.least("rid", "b").alias("a"), F.greatest("rid", "b").alias("b")).distinct()
    labels = merge_labels(labels, _link(pairs, sets, threshold))
    held = stored(_open(met.select("key", "rid", "total"), labels), "open")
    if held.isEmpty():
        return labels
    held = stored(held.join(_shared_weight(held, sets), "rid"), "open")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own, every = F.pmod(F.xxhash64("rid"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    left = held.select("key", "rid", "label", "total", "shared", own.alias("i"), every.alias("j"))
    right = held.select(
        "key",
        F.col("rid").alias("b"),
        F.col("label").alias("lb"),
        F.col("total").alias("other"),
        F.col("shared").alias("other_shared"),
        every.alias("i"),
        own.alias("j"),
    )
    common = sum((F.least(F.col("shared")[g], F.col("other_shared")[g]) for g in range(1, GROUPS)), F.least(F.col("shared")[0], F.col("other_shared")[0]))
    close = (F.col("rid") < F.col("b")) & (F.col("label") != F.col("lb")) & _possible(common, "total", "other", threshold)
    pairs = left.join(right, ["key", "i", "j"]).filter(close).select(F.col("rid").alias("a"), "b").distinct()
    return merge_labels(labels, _link(pairs, sets, threshold))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", threshold: float = THRESHOLD, weighting: str = "presence"
) -> DataFrame:
    """One row per document: id, class_id, class_size, kept, text_key (md5 of the text).

    Sets are the 5-word shingles of the whole text (words in lower case; fewer than five words are
    one shingle), each of weight 1 (``presence``) or of its number of occurrences (``count``). Two
    texts are linked from ``threshold`` on, and classes are what links connect. class_id is the
    smallest id of the class, whose row is kept (exactly one row; null ids come last). Texts
    without any word, null and empty among them, are alike only if equal, null being empty. Equal
    texts are compared once. Ids are read as 64-bit numbers. Other columns are not read.
    """
    texts = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key")
    )
    rows = texts.mapInPandas(
        _signature_batches(weighting),
        "doc_id long, text_key string, digest string, total double, shingles array<int>, weights array<float>, bands array<long>",
    )
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "signatures")
    ids = rows.select("rid", "doc_id", "digest", "text_key")
    first = stored(ids.groupBy("digest").agg(F.min("rid").alias("first")), "first")
    sets = stored(rows.join(first.select(F.col("first").alias("rid")), "rid"), "sets")
    labels = _classes(sets, threshold)
    named = first.join(labels, first["first"] == labels["rid"], "left").select(
        "digest", F.coalesce("label", "first").alias("label")
    )
    labelled = stored(ids.join(named, "digest").select("rid", "doc_id", "text_key", "label"), "labelled")
    classes = stored(
        labelled.groupBy("label").agg(
            F.count("*").alias("class_size"),
            F.min("doc_id").alias("class_id"),
            F.coalesce(F.min_by("rid", "doc_id"), F.min("rid")).alias("keep_rid"),
        ),
        "classes",
    )
    return labelled.join(classes, "label").select(
        F.col("doc_id").alias(id_column),
        "class_id",
        "class_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        "text_key",
    )


def text_key() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def keep_one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_duplicates`` keeps.

    Rows are told apart by id and text; of rows equal in both, one stays. Only the keys of the rows
    that go are joined, and rows that repeat are the only ones grouped with their texts.
    """
    found = near_duplicates(docs, **options)
    rows = stored(
        found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(
            F.bool_or("kept").alias("__kept"), F.count("*").alias("__n")
        ),
        "verdicts",
    )
    keyed = docs.withColumn("__text_key", text_key())
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed["__text_key"] == F.col("__key"))
    repeated = rows.filter("__kept AND __n > 1")
    once = keyed.join(rows.filter("NOT __kept OR __n > 1"), same, "left_anti")
    again = keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__text_key"])
    return once.unionByName(again).drop("__text_key")
