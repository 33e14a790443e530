import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldledger.llm import dart_minhash
from fieldledger.llm.dart_minhash import (
    COORDINATES,
    keep_one_per_class,
    near_duplicates,
    shingles_of,
    signatures,
    similarity,
)
from fieldledger.llm.spaced_seeds import tokens_of
from tests.llm.conftest import make_docs, prose


def sets_to_rows(sets):
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.array([k for s in sets for k in s], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return owner, element, np.array([w for s in sets for w in s.values()], dtype=float)


def agreement(sets):
    sig = signatures(*sets_to_rows(sets), len(sets))
    assert np.isfinite(sig).all()
    return (sig[0] == sig[1]).mean()


@pytest.mark.parametrize("scale", [0.3, 1.0, 5.0])
@pytest.mark.parametrize("size", [3, 40, 3000])
def test_signatures_estimate_weighted_jaccard(scale, size):
    """Mean agreement over many pairs against the exact similarity of the weighted sets."""
    rng = random.Random(size)
    estimates, exact = [], []
    for t in range(12):
        a = {1000 * t * size + i: rng.uniform(0.2, 2) * scale for i in range(size)}
        b = {k: w * rng.choice([1, 1, 1, 0.5, 1.7]) for k, w in a.items() if rng.random() < 0.9 or k % size == 0}
        common = sum(min(a[k], b[k]) for k in b)
        exact.append(common / (sum(a.values()) + sum(b.values()) - common))
        estimates.append(agreement([a, b]))
    assert abs(np.mean(estimates) - np.mean(exact)) < 5 * 0.5 / np.sqrt(12 * COORDINATES)


def test_scaled_sets_of_one_element():
    assert abs(agreement([{1: 1.0}, {1: 4.0}]) - 0.25) < 0.15
    assert agreement([{1: 3.0}, {1: 3.0}]) == 1


def shingle_set(text, weighting="presence"):
    tokens, _ = tokens_of([text or ""])
    values, counts = shingles_of(tokens)
    return values, counts if weighting == "count" else None


def brute_classes(rows, weighting="presence", threshold=0.8):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_set(t, weighting) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            (a, wa), (b, wb) = sets[i], sets[j]
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (len(a) and len(b) and similarity(a, b, wa, wb) >= threshold):
                parent[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(i)
    return list(classes.values())


def check(rows, out):
    """Classes by brute force against class_id, class_size and kept."""
    expected = Counter()
    for members in brute_classes(rows):
        ids = [rows[i][0] for i in members]
        low = min((i for i in ids if i is not None), default=None)
        expected.update((i, low, len(ids)) for i in ids)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in out) == expected
    assert sum(r.kept for r in out) == len(brute_classes(rows))


def mutated(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "edit" + str(rng.random())
    return " ".join(words)


def test_near_copies_match_brute_force(spark, tricky_rows):
    rng = random.Random(3)
    rows = list(tricky_rows)
    for base in range(8):
        text = prose(50 + base, rng.choice([8, 30, 200, 400]))
        rows += [(1000 * base + 100 + i, mutated(text, rng, rng.randint(0, 9))) for i in range(12)]
    check(rows, near_duplicates(make_docs(spark, rows)).collect())


def test_copies_that_only_meet_through_their_original(spark):
    """Sixty variants, each near the original and mostly not near each other."""
    rng = random.Random(4)
    text = prose(77, 300)
    variants = [(i, mutated(text, rng, 5)) for i in range(60)]
    rows = [*variants, (500, text), *[(600 + i, prose(900 + i, 80)) for i in range(10)]]
    check(rows, near_duplicates(make_docs(spark, rows)).collect())


def test_repeated_lines_by_weighting(spark):
    line, tail = prose(5, 12), prose(6, 40)
    rows = [(1, " ".join([line] * 2) + " " + tail), (2, " ".join([line] * 30) + " " + tail)]
    docs = make_docs(spark, rows)
    assert {r.class_id for r in near_duplicates(docs).collect()} == {1}
    assert {r.class_id for r in near_duplicates(docs, weighting="count").collect()} == {1, 2}


def test_one_row_of_each_class_stays(spark, tricky_rows):
    rows = [*tricky_rows, (20, prose(2, 60) + " end"), (21, prose(2, 60))]
    docs = make_docs(spark, rows)
    kept = keep_one_per_class(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert len(out) == len(brute_classes(rows))
    assert {r.doc_id for r in out if (r.text or "").startswith(prose(2, 60))} == {9}


def test_no_documents(no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert keep_one_per_class(no_docs).count() == 0


def test_large_group_in_blocks(spark, monkeypatch):
    """A few hundred variants around the threshold: many links, many that just miss, no pair lost."""
    monkeypatch.setattr(dart_minhash, "BLOCK", 16)
    rng = random.Random(12)
    text = prose(31, 150)
    rows = [(i, mutated(text, rng, rng.randint(1, 9))) for i in range(250)] + [(900, text)]
    check(rows, near_duplicates(make_docs(spark, rows)).collect())


def test_shingles_that_fall_together_count_once():
    values = np.array([1 << 40, (1 << 40) + 5, 1 << 50], dtype=np.uint64)
    short, weights = dart_minhash._shortened(values, np.array([1.0, 2.0, 1.0]))
    assert len(short) == 2 and sorted(weights) == [1.0, 3.0]
