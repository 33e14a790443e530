"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of the token positions of a window and ignore the others. Windows of the
benchmark and of the documents are hashed under every mask and joined on the hash; around each hit
the two token rows are laid side by side and the best stretch with few substitutions is measured.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import mix64, stored, text_slices

#: The masks; 1 is compared, 0 may differ.
MASKS = ("11111", "1101011", "11001011", "101011001", "1000110101", "110000010011")
#: A text with fewer tokens has no window; it is hashed as a whole.
SHORTEST = min(map(len, MASKS))
#: Tokens of context kept on both sides of the outermost hits; hits nearer than twice that share a stretch.
REACH = 64
#: An overlap counts from so many tokens, of which this share is equal; every such overlap holds a
#: whole window of some mask. A shorter item counts if all of it is there without a substitution.
MIN_TOKENS = 13
MIN_SIMILARITY = 0.8
#: Bounds of the bitmap of benchmark hashes that travels to the tasks: at most 8 MiB, whatever the benchmark's size.
MIN_BITS, MAX_BITS = 16, 26

_WORD = re.compile(r"\w+")


def tokens_of(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit token hashes of all texts in a row, and the number of tokens of each."""
    lists = [_WORD.findall(t.lower()) for t in texts]
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [w for x in lists for w in x]
    return pd.util.hash_array(flat, categorize=True), counts


def window_hashes(tokens: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the window that starts at each position, for all that fit."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15 * (number + 1) % 2**64, dtype=np.uint64)
    for at in (i for i, c in enumerate(mask) if c == "1"):
        out = out * np.uint64(0xD6E8FEB86659FD93) + tokens[at : at + n]
    return mix64(out)


def whole_hash(tokens: np.ndarray) -> np.ndarray:
    """Hash of a whole text that is too short for any window."""
    return window_hashes(tokens, "1" * len(tokens), len(MASKS) + len(tokens))


def _item_windows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in text_slices(batches):
        tokens, counts = tokens_of(rows.text)
        ends = np.cumsum(counts)
        for item, start, end in zip(rows.item, ends - counts, ends, strict=True):
            own = tokens[start:end]
            found = [window_hashes(own, mask, number) for number, mask in enumerate(MASKS)]
            if 0 < len(own) < SHORTEST:
                found.append(whole_hash(own))
            for hashes in found:
                yield pd.DataFrame(
                    {"item": item, "hash": hashes.view(np.int64), "item_at": np.arange(len(hashes), dtype=np.int32)}
                )


def _item_tokens(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in text_slices(batches):
        tokens, counts = tokens_of(rows.text)
        parts = np.split(tokens.view(np.int64), np.cumsum(counts)[:-1])
        yield pd.DataFrame({"item": rows.item, "item_tokens": parts})


def hash_bitmap(windows: DataFrame) -> tuple[int, np.ndarray]:
    """Bits, and flags of the two places of that many bits that the hash of each window has."""
    found = windows.select(F.approx_count_distinct("hash").alias("n")).first()
    bits = min(MAX_BITS, max(MIN_BITS, int(found.n * 256).bit_length()))
    places = F.array(
        F.shiftrightunsigned("hash", 64 - bits),
        F.shiftrightunsigned("hash", 64 - 2 * bits).bitwiseAND(F.lit((1 << bits) - 1)),
    )
    words = (
        windows.select(F.explode(places).alias("place"))
        .groupBy(F.floor(F.col("place") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("present"))
    ).toPandas()
    packed = np.zeros(1 << (bits - 6), dtype=np.uint64)
    packed[words.word.to_numpy(dtype=np.int64)] = words.present.to_numpy(dtype=np.int64).view(np.uint64)
    return bits, packed


def _flagged(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((flags[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1)).astype(bool)


def _stretches(bits: int, packed):
    """Task function: stretches of document tokens around positions whose hash may be known."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = packed.value
        first, second, low = np.uint64(64 - bits), np.uint64(64 - 2 * bits), np.uint64((1 << bits) - 1)
        for rows in text_slices(batches):
            tokens, counts = tokens_of(rows.text)
            ends = np.cumsum(counts)
            at, hashes, masks = [], [], []
            for d in np.flatnonzero((counts > 0) & (counts < SHORTEST)):
                own = whole_hash(tokens[ends[d] - counts[d] : ends[d]])
                if _flagged(flags, own >> first)[0] and _flagged(flags, (own >> second) & low)[0]:
                    at.append(np.array([ends[d] - counts[d]]))
                    hashes.append(own)
                    masks.append(counts[d : d + 1])
            for number, mask in enumerate(MASKS):
                all_hashes = window_hashes(tokens, mask, number)
                hit = np.flatnonzero(_flagged(flags, all_hashes >> first))
                hit = hit[_flagged(flags, (all_hashes[hit] >> second) & low)]
                at.append(hit)
                hashes.append(all_hashes[hit])
                masks.append(np.full(len(hit), len(mask)))
            at, hashes, spans = np.concatenate(at), np.concatenate(hashes), np.concatenate(masks)
            if not len(at):
                continue
            doc = np.searchsorted(ends, at, side="right")
            inside = at + spans <= ends[doc]  # windows over the end of a document are none
            at, hashes, doc = at[inside], hashes[inside], doc[inside]
            order = np.argsort(at, kind="stable")
            at, hashes, doc = at[order], hashes[order], doc[order]
            if not len(at):
                continue
            cut = np.flatnonzero((np.diff(at) > 2 * REACH) | (np.diff(doc) != 0)) + 1
            out = []
            for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(at)], strict=True):
                d = doc[lo]
                start = max(ends[d] - counts[d], at[lo] - REACH)
                stop = min(ends[d], at[hi - 1] + REACH)
                out.append(
                    (
                        rows.doc_id.iloc[d],
                        hashlib.md5(rows.text.iloc[d].encode()).hexdigest(),
                        int(start - (ends[d] - counts[d])),
                        tokens[start:stop].view(np.int64),
                        hashes[lo:hi].view(np.int64),
                        (at[lo:hi] - start).astype(np.int32),
                    )
                )
            frame = pd.DataFrame(out, columns=["doc_id", "doc_key", "start", "tokens", "hashes", "places"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return run


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """Longest stretch of which MIN_SIMILARITY is equal when item position i lies on document
    position i + shift: start in the document, start in the item, tokens, equal tokens. It begins
    and ends with equal tokens. A match earns 1 - MIN_SIMILARITY and a substitution costs
    MIN_SIMILARITY, so a stretch has that share if its sum is not negative."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    equal = doc[lo + shift : hi + shift] == item[lo:hi] if hi > lo else np.empty(0, dtype=bool)
    if not equal.any():
        return 0, 0, 0, 0
    gain = np.where(equal, round(100 * (1 - MIN_SIMILARITY)), -round(100 * MIN_SIMILARITY))
    total = np.concatenate([[0], np.cumsum(gain)])
    starts, ends = np.flatnonzero(equal), np.flatnonzero(equal) + 1
    lowest = np.minimum.accumulate(total[starts])  # falls, so the first start that is low enough is found by search
    first = starts[np.searchsorted(-lowest, -total[ends], side="left")]
    best = int(np.argmax(ends - first))
    start, stop = int(first[best]), int(ends[best])
    return lo + start + shift, lo + start, stop - start, int(equal[start:stop].sum())


def counts_as_overlap(tokens: int, equal: int, item_tokens: int) -> bool:
    if item_tokens < MIN_TOKENS:
        return equal == item_tokens
    return tokens >= MIN_TOKENS and equal >= MIN_SIMILARITY * tokens


def _verify(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            at, item_at, length, same = best_overlap(r.tokens, r.item_tokens, r.shift)
            if counts_as_overlap(length, same, len(r.item_tokens)):
                out.append((r.sid, r.item, r.start + at, item_at, length, same))
        yield pd.DataFrame(out, columns=["sid", "item", "doc_start", "item_start", "tokens", "equal_tokens"])


def _overlaps(docs: DataFrame, benchmark: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """Overlaps around each possible hit, with doc_id, doc_key (md5 of the text), item_id, and the
    item's row number in ``item``."""
    items = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "items")
    windows = stored(items.select("item", "text").mapInPandas(_item_windows, "item long, hash long, item_at int"), "windows")
    bits, packed = hash_bitmap(windows)
    flags = docs.sparkSession.sparkContext.broadcast(packed)
    texts = docs.select(F.col(doc_key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stretches = texts.mapInPandas(
        _stretches(bits, flags),
        "doc_id long, doc_key string, start int, tokens array<long>, hashes array<long>, places array<int>",
    )
    stretches = stored(stretches.withColumn("sid", F.monotonically_increasing_id()), "stretches")
    hits = stretches.select("sid", F.explode(F.arrays_zip("hashes", "places")).alias("h")).select(
        "sid", F.col("h.hashes").alias("hash"), F.col("h.places").alias("place")
    )
    pairs = (
        hits.join(windows, "hash")
        .select("sid", "item", (F.col("place") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    item_tokens = items.select("item", "text").mapInPandas(_item_tokens, "item long, item_tokens array<long>")
    checked = (
        pairs.join(stretches.select("sid", "start", "tokens"), "sid")
        .join(item_tokens, "item")
        .mapInPandas(_verify, "sid long, item long, doc_start long, item_start long, tokens long, equal_tokens long")
    )
    return checked.join(stretches.select("sid", "doc_id", "doc_key"), "sid").join(items.select("item", "item_id"), "item")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, doc_start, item_start, tokens,
    equal_tokens of the longest such stretch (in words, from 0).

    Words are runs of letters, digits and underscores in lower case. An item of fewer than five
    words has no window; it matches the documents that are those words and no others. Null and
    empty texts have no words. Rows without id take part with a null id. Documents of one id (or of
    none) share their row; items are told apart by row, so items of one id each have theirs.
    Insertions end a stretch; each side of one counts by itself. Only stretches around possible hits
    are shuffled, never whole documents.
    """
    best = F.max(F.struct("tokens", "equal_tokens", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i")))
    found = _overlaps(docs, benchmark, doc_key, item_key).groupBy("doc_id", "item", "item_id").agg(best.alias("b"))
    return found.select(
        "doc_id",
        "item_id",
        (-F.col("b.d")).alias("doc_start"),
        (-F.col("b.i")).alias("item_start"),
        F.col("b.tokens").alias("tokens"),
        F.col("b.equal_tokens").alias("equal_tokens"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item, with all their columns. A document is known by its id
    (null being one) and its text, so one that shares its id with a contaminated one stays."""
    found = _overlaps(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key")).distinct()
    own = F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (own == F.col("__key")), "left_anti")
