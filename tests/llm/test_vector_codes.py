import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from fieldledger.llm import vector_codes
from fieldledger.llm.queries import ORACLES, op12_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, label_error int"


def brute(rows, entries=256, rounds=4, parts=4):
    """(vec_id, label, code, error) rows in plain integers, label errors, and the digest."""
    kept = [
        (i, [math.floor(1024 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return Counter(), None
    dims = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dims]
    cut = [dims * k // parts for k in range(parts + 1)]
    pieces = [[r[1][a:b] for a, b in zip(cut, cut[1:], strict=False)] for r in kept]
    books = [[p[k] for p in pieces[:entries]] for k in range(parts)]

    def assign():
        out = []
        for vector in pieces:
            found = []
            for part, book in zip(vector, books, strict=True):
                found.append(min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), i) for i, e in enumerate(book)))
            out.append(found)
        return out

    for _ in range(rounds):
        members = defaultdict(list)
        for vector, found in zip(pieces, assign(), strict=True):
            for k, (_, e) in enumerate(found):
                members[k, e].append(vector[k])
        for (k, e), own in members.items():
            books[k][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found, by_label = assign(), Counter()
    for (_, _, label), f in zip(kept, found, strict=True):
        by_label[label] += sum(d for d, _ in f)
    text = ",".join(str(x) for book in books for e in book for x in e)
    return Counter(
        (i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), by_label[label])
        for (i, _, label), f in zip(kept, found, strict=True)
    ), hashlib.sha256(text.encode()).hexdigest()


def vectors(rng, count, dims=8):
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(6)]
    return [[rng.gauss(x, 0.05) for x in rng.choice(centres)] for _ in range(count)]


def single(x):
    """As a 32-bit float, which is what the table holds."""
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "x", 0) for i, v, label in rows], SCHEMA).repartition(3)


def check(spark, rows, **options):
    rows = [(i, v and [x if x is None else single(x) for x in v], label) for i, v, label in rows]
    coded, books = vector_codes.encode(frame(spark, rows), **options)
    out = vector_codes.with_label_error(coded).collect()
    expected, digest = brute(rows, **options)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in out) == expected
    if expected:
        assert vector_codes.codebooks_digest(books) == digest


def test_codes_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, v, rng.choice([1, 2, None])) for i, v in enumerate(vectors(rng, 400))]
    check(spark, rows, entries=32)


def test_odd_rows(spark):
    """Nulls, not-a-number, infinities, other lengths, repeated and unnumbered rows, ties."""
    rng = random.Random(3)
    rows = [(i % 40, v, i % 3 or None) for i, v in enumerate(vectors(rng, 60))]
    rows += [(None, v, 1) for v in vectors(rng, 5)]
    rows += [rows[0]] * 30 + [(50, [0.0] * 8, 9), (51, [0.0005] * 8, 9), (52, [-0.0005] * 8, 9)]
    rows += [(60, None, 1), (61, [None] + [0.1] * 7, 1), (62, [float("nan")] * 8, 1), (63, [0.1] * 7 + [float("-inf")], 1)]
    rows += [(64, [0.5] * 4, 1), (65, [], 2), (66, [100.0] * 8, 3), (67, [-120000.0] * 8, 4)]
    check(spark, rows, entries=16)
    check(spark, rows, entries=256)


def test_first_rows_of_other_lengths(spark):
    rng = random.Random(4)
    rows = [(0, [0.1] * 8, 1), (1, [0.1] * 3, 1), *((i + 2, v, 1) for i, v in enumerate(vectors(rng, 30)))]
    check(spark, rows, entries=8)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1), (2, [], None)], [(1, [0.25] * 8, 1)]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_uneven_parts(spark):
    rng = random.Random(5)
    check(spark, [(i, v, 1) for i, v in enumerate(vectors(rng, 50, dims=7))], entries=8)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    monkeypatch.setattr(vector_codes, "CHUNK", 3)
    rng = random.Random(6)
    check(spark, [(i, v, i % 2) for i, v in enumerate(vectors(rng, 100))], entries=8)


def test_huge_values_saturate():
    assert vector_codes.integers(vector_codes.np.array([3e38, -3e38, 1.0]), 64).tolist() == [2**27, -(2**27), 1024]


def test_statement_and_query(spark):
    folder = "/root/testdata/sf0.001"
    out = op12_vector_codes(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet'")
    wanted = con.sql(f"SELECT {', '.join(out.columns)} FROM ({ORACLES['op12_vector_codes']})").fetchall()
    assert Counter(map(tuple, out.collect())) == Counter(wanted) and wanted
