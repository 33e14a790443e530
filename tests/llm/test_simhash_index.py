import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from fieldledger.llm import simhash_index as index
from fieldledger.llm.queries import op13_simhash_index
from tests.llm.conftest import make_docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    size = min(3, len(words))
    hashes = [
        xxhash.xxh64(" ".join(words[i : i + size]).encode(), seed=42).intdigest()
        for i in range(len(words) - size + 1 if words else 0)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, distance=2):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= distance:
            parent[find(a)] = find(b)
    return {v: find(v) for v in parent}


def brute_rows(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    of = classes(prints)
    low = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            low[of[p]] = min(i, low.get(of[p], i))
    return Counter((i, f"{p:016x}", low.get(of[p])) for (i, _), p in zip(rows, prints, strict=True))


def flipped(value, rng, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def signed(values):
    return [v - (1 << 64) if v >> 63 else v for v in values]


def test_majority_of_many_hashes():
    rng = random.Random(1)
    sizes = [0, 1, 2, 255, 256, 0, 511, 900]
    hashes = [rng.getrandbits(64) & rng.choice([2**64 - 1, 2**63, 2**40 - 1]) for _ in range(sum(sizes))]
    got, at = index.majority_bits(np.array(hashes, dtype=np.uint64), np.array(sizes)), 0
    for size, value in zip(sizes, got.tolist(), strict=True):
        own = hashes[at : at + size]
        assert value == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > size)
        at += size


def test_fingerprints_match_brute_force():
    texts = ["", None, "  ", "One", "ONE two", "one two three", "Ünder Über EINS zwei drei", "a b c\x1cd e", "x " * 700, prose(3, 3000)]
    assert index.fingerprint_texts(texts).tolist() == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("distance", [1, 2])
def test_links_join_what_pairs_join(spark, distance):
    """Chains and dense balls of fingerprints, some of them with thousands of pairs in one list."""
    rng = random.Random(distance)
    values = {0, 1, 2**63, 2**64 - 1}
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(12):
            values.add(at)
            at = flipped(at, rng, rng.randint(1, 4))
    centre = rng.getrandbits(64)
    values |= {centre ^ low for low in rng.sample(range(1 << 16), 300)}
    df = spark.createDataFrame([(v,) for v in signed(sorted(values))], "fp long").repartition(4)
    parent = {v: v for v in signed(values)}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in index.links(df, distance).collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 16  # of one list
        parent[find(a)] = find(b)
    expected = Counter(Counter(classes(values, distance).values()).values())
    assert Counter(Counter(find(v) for v in parent).values()) == expected
    assert max(expected) >= 5


def test_query_matches_brute_force(spark, tricky_rows, tmp_path):
    rng = random.Random(6)
    rows = list(tricky_rows)
    for base in range(12):
        words = prose(80 + base, 200).split()
        for i in range(15):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "word", "Here"])
            rows.append((1000 * base + 90 + i, (" " if i % 2 else "\n").join(copy)))
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = op13_simhash_index(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, out)) == brute_rows(rows)
    assert max(Counter(r.component_id for r in out).values()) > 5


def test_long_chain(spark):
    """Two bits on with each step: one component, found in few turns."""
    values, at = [0], 0
    for k in range(32):
        at |= 3 << (2 * k)
        values.append(at)
    found = index.links(spark.createDataFrame([(v,) for v in signed(values)], "fp long"))
    ends = found.select("a").union(found.select("b")).distinct().toDF("rid").selectExpr("rid", "rid AS label")
    assert index.merge_labels(ends, found).select("label").distinct().count() == 1


def test_no_documents(no_docs):
    assert index.near_duplicates(no_docs).count() == 0
