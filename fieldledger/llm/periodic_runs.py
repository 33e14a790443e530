"""Periodic runs of words: Lyndon arrays by Baier grouping, Lyndon roots extended into runs.

The first phase of Baier's suffix sorter puts all positions into groups by their first word and goes
through the groups from the highest down. A position of the group at hand has its final prefix; it
is appended to the nearest position on its left that lies in a lower group, whose own group is split
by how many such prefixes its members took. The length a group has when its turn comes is the
longest Lyndon word at its positions, so this phase alone gives the Lyndon array. Under one of the
two word orders the roots of a run are longest Lyndon words (the runs theorem), hence both arrays
and the longest common extensions to both sides of neighbouring equal roots give every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldledger.llm.common import arrow_slices, mix64

#: A run counts from so many words, and from so many times its period.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Moduli of the prefix sums by which extensions are found; each extension is then compared word by word.
MODULI = (2**31 - 1, 2**31 - 19)


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position; the empty suffix is the
    lowest. Nearly linear: a position is appended once, and splits touch the appended-to only."""
    n = len(ranks)
    out = [0] * n
    # Place 0 stands before the text and never leaves; position i is place i + 1.
    left = list(range(n + 1))  # nearest open place at or left of a place, shortened as it is used
    group = [0, *ranks]
    heads = sorted(set(ranks))
    members: dict[int, list[int]] = {h: [] for h in heads}
    for place in range(1, n + 1):
        members[group[place]].append(place)
    live = {h: len(m) for h, m in members.items()}
    length = dict.fromkeys(heads, 1)
    below = dict(zip(heads[1:], heads, strict=False))
    above = dict(zip(heads, heads[1:], strict=False))
    fresh = max(heads, default=0) + 1
    current = heads[-1] if heads else None
    while current is not None:
        size = length[current]
        places = [p for p in members.pop(current) if group[p] == current]
        for place in places:
            out[place - 1] = size
            left[place] = place - 1
        taken: dict[int, int] = {}
        for place in places:
            at = place
            while left[at] != at:
                left[at] = left[left[at]]
                at = left[at]
            left[place] = at
            if at:
                taken[at] = taken.get(at, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for at, times in taken.items():
            moves.setdefault((times, group[at]), []).append(at)
        # More copies of the prefix are higher; each new group comes directly above the old one.
        for (times, old), moved in sorted(moves.items(), reverse=True) if len(moves) > 1 else moves.items():
            if len(moved) == live[old]:
                length[old] += times * size
                continue
            members[fresh], live[fresh], length[fresh] = moved, len(moved), length[old] + times * size
            live[old] -= len(moved)
            for at in moved:
                group[at] = fresh
            higher = above[old]  # exists: the group at hand is higher than the old one
            above[old], below[fresh], above[fresh], below[higher] = fresh, old, higher, fresh
            fresh += 1
        current = below.get(current)
    return out


class Extensions:
    """Longest common extensions of two places of a row of ids, for many pairs at once."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.sums, self.powers = [], []
        for modulus in MODULI:
            power = np.ones(self.n + 1, dtype=np.uint64)
            base, done = 1_000_003, 1
            while done <= self.n:
                power[done : 2 * done] = power[: min(done, self.n + 1 - done)] * np.uint64(base) % np.uint64(modulus)
                base, done = base * base % modulus, 2 * done
            terms = (ids.astype(np.uint64) + np.uint64(1)) % np.uint64(modulus) * power[:-1] % np.uint64(modulus)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]) % np.uint64(modulus))
            self.powers.append(power)

    def _equal(self, a: np.ndarray, apart: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` ids from a on equal those from a + apart on, by their sums."""
        same = np.ones(len(a), dtype=bool)
        for modulus, total, power in zip(MODULI, self.sums, self.powers, strict=True):
            m = np.uint64(modulus)
            one = (total[a + size] + m - total[a]) % m * power[apart] % m
            two = (total[a + apart + size] + m - total[a + apart]) % m
            same &= one == two
        return same

    def right(self, a: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """How many ids from a on equal those from a + apart on."""
        found = np.zeros(len(a), dtype=np.int64)
        for bit in range(self.n.bit_length(), -1, -1):
            room = np.flatnonzero(a + apart + found + (1 << bit) <= self.n)
            step = self._equal(a[room] + found[room], apart[room], np.full(len(room), 1 << bit))
            found[room[step]] += 1 << bit
        return found

    def left(self, a: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """How many ids before a equal those before a + apart."""
        found = np.zeros(len(a), dtype=np.int64)
        for bit in range(self.n.bit_length(), -1, -1):
            room = np.flatnonzero(a - found - (1 << bit) >= 0)
            step = self._equal(a[room] - found[room] - (1 << bit), apart[room], np.full(len(room), 1 << bit))
            found[room[step]] += 1 << bit
        return found


def _around(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """Start and length of the stretch around ``at`` with ``period``, word by word."""
    same = ids[:-period] == ids[period:]
    broken = np.flatnonzero(~same)
    cut = int(np.searchsorted(broken, at))
    start = int(broken[cut - 1]) + 1 if cut else 0
    stop = int(broken[cut]) if cut < len(broken) else len(same)
    return start, stop - start + period


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> set[tuple[int, int, int]]:
    """Runs (start, length, period) of a row of ids, of at least ``min_length`` ids and
    ``min_exponent`` (3 or more) periods."""
    ranks = np.unique(ids, return_inverse=True)[1]
    found: set[tuple[int, int, int]] = set()
    extensions = None
    for order in (ranks, ranks.max(initial=0) - ranks):
        root = np.array(lyndon_array(order.tolist()), dtype=np.int64)
        at = np.arange(len(root))
        after = at + root
        # A run of three periods holds two whole neighbouring roots.
        twice = np.zeros(len(root), dtype=bool)
        inside = after < len(root)
        twice[inside] = root[after[inside]] == root[inside]
        at = at[twice]
        if not len(at):
            continue
        extensions = extensions or Extensions(ranks)
        right = extensions.right(at, root[at])
        whole = right >= root[at]  # else the two roots only have the same length
        at, right = at[whole], right[whole]
        # Roots that follow one another lead to the same run; the first is enough.
        same = np.zeros(len(root), dtype=bool)
        same[at] = True
        before = at - root[at]
        later = (before >= 0) & same[before] & (root[before] == root[at])
        at, right = at[~later], right[~later]
        period = root[at]
        start = at - extensions.left(at, period)
        length = at + period + right - start
        counts = (length >= min_length) & (length >= min_exponent * period)
        for i, s, size, p in zip(*(x[counts].tolist() for x in (at, start, length, period)), strict=True):
            if (s, size, p) in found:
                continue
            if not np.array_equal(ranks[s : s + size - p], ranks[s + p : s + size]):
                s, size = _around(ranks, i, p)
                if size < max(min_length, min_exponent * p):
                    continue
            found.add((s, size, p))
    return found


def _stretches(keys: np.ndarray, owner: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Stretches (from, to) that may hold runs. Every three neighbouring words inside a run occur at
    least ``min_exponent`` - 1 times in it, so words that are in no such triple of their text (then of
    their stretch, and so on) are in no run, and no run goes over them. Counts are by hash: they can
    only be too high."""
    at = np.arange(len(keys))
    part = owner.astype(np.int64)
    salt = 1
    while len(at) >= min_length:
        whole = np.flatnonzero((part[2:] == part[:-2]) & (at[2:] - at[:-2] == 2))
        mixed = mix64(keys[at[whole]] * np.uint64(3) + mix64(keys[at[whole + 1]] * np.uint64(5) + mix64(keys[at[whole + 2]])))
        mixed = mix64(mixed + part[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
        slots = mixed >> np.uint64(64 - max(10, (4 * len(whole)).bit_length()))
        often = whole[np.bincount(slots.astype(np.int64))[slots.astype(np.int64)] >= min_exponent - 1] if len(whole) else whole
        marked = np.zeros(len(at), dtype=bool)
        for k in range(3):
            marked[often + k] = True
        # A new stretch starts at a gap and where two neighbouring triples are not both frequent.
        linked = np.zeros(len(at), dtype=bool)
        linked[often + 1] = True
        linked[often + 2] = True
        starts = marked & ~linked
        left = np.flatnonzero(marked)
        number = np.cumsum(starts)[left]
        sizes = np.bincount(number, minlength=1)
        kept = left[sizes[number] >= min_length]
        done = len(kept) > 0.9 * len(at)
        at, part, salt = at[kept], np.cumsum(starts)[kept], salt + 1
        if done:
            break
    if len(at) < min_length:
        return []
    cuts = np.flatnonzero(np.diff(part)) + 1
    return list(zip(at[np.r_[0, cuts]].tolist(), (at[np.r_[cuts - 1, len(at) - 1]] + 1).tolist(), strict=True))


def text_runs(
    texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, given as words, by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    total = int(sizes.sum())
    keys = np.fromiter((hash(w) for t in texts for w in t), dtype=np.int64, count=total).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if min_length > min_exponent:
        parts = _stretches(keys, owner, min_length, min_exponent)
    else:
        parts = [(int(e - s), int(e)) for s, e in zip(sizes, ends, strict=True) if s]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for lo, hi in parts:
        text = int(owner[lo])
        first = lo - int(ends[text] - sizes[text])
        words = texts[text][first : first + hi - lo]
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        ids = np.array([number[w] for w in words], dtype=np.int64)
        out[text] += [(first + s, size, p) for s, size, p in runs_of(ids, min_length, min_exponent)]
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def collapse(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> bytes:
    """The words that are in no run after its first period, joined by single spaces."""
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(step)[:-1] == 0)
    return b" ".join([words[i] for i in kept])


def _run_batches(min_length: int, min_exponent: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches):
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            found = text_runs(texts, min_length, min_exponent)
            spans = [pa.array([[r[k] for r in runs] for runs in found], pa.list_(pa.int64())) for k in range(3)]
            kept = [(collapse(w, r) if r else b" ".join(w)).decode() for w, r in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *spans, pa.array(kept, pa.string())], schema=schema)

    return run


def periodic_runs(
    docs: DataFrame, id_column: str = "doc_id", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """One row per document: id, runs (array of start, length, period, by start, then period) and
    collapsed, the text without the repeats.

    Words are what spaces and the control characters 9 to 13 part, compared byte for byte and
    numbered from 0. A run is a longest stretch of one smallest period with at least ``min_length``
    words and ``min_exponent`` (at least 3) periods. ``collapsed`` has each run's first period only
    and single spaces. Null and empty texts have no words, no runs and an empty collapsed text; rows
    with a null id or the same id stay rows of their own. Other columns are not read. Only words in
    triples that occur often enough for a run go through the grouping; a text is never cut. A task
    holds one slice of texts, or its longest text.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")
    rows = docs.select(F.col(id_column), F.col("text").cast("string").alias("__text"))
    id_type = rows.schema[0].dataType
    schema = pa.schema(
        [
            (id_column, to_arrow_type(id_type)),
            ("start", pa.list_(pa.int64())),
            ("length", pa.list_(pa.int64())),
            ("period", pa.list_(pa.int64())),
            ("collapsed", pa.string()),
        ]
    )
    found = rows.mapInArrow(
        _run_batches(min_length, min_exponent, schema),
        f"`{id_column}` {id_type.simpleString()}, start array<long>, length array<long>, period array<long>, collapsed string",
    )
    return found.select(id_column, F.arrays_zip("start", "length", "period").alias("runs"), "collapsed")


def strongest(runs: Column) -> Column:
    """The run of the greatest length by period (exact); ties by smallest start, then period."""

    def order(a: Column, b: Column) -> Column:
        one, two = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(one > two, -1)
            .when(one < two, 1)
            .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
        )

    return F.get(F.array_sort(runs, order), F.lit(0))


def repeat_tail(docs: DataFrame) -> DataFrame:
    """The documents, of which one in ten (by crc32 of its id) has its words from some place on
    replaced by repeats of the words there. Rows without id stay as they are."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(number / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = F.when((number % 10 == 0), words)
    parts = docs.withColumn("__words", chosen)
    n = F.when(F.size("__words") > 0, F.size("__words"))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("__words", a + 1, p), times)), F.lit(1), n - a)
    repeated = F.array_join(F.concat(F.slice("__words", F.lit(1), a), tail), " ")
    return parts.withColumn("text", F.coalesce(repeated, "text")).drop("__words")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and SHA-256 of the list of runs and of the collapsed text."""
    best = strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("__best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"__best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("__best.length") / F.col("__best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
