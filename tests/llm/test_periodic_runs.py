import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest

from fieldledger.llm import periodic_runs as runs
from tests.llm.conftest import make_docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lyndon(ranks):
    out = []
    for i in range(len(ranks)):
        j = i + 1
        while j < len(ranks) and ranks[j:] > ranks[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(words, min_length=6, min_exponent=4):
    found, n = set(), len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            root = words[i : i + q]
            primitive = not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q))
            if primitive and j - i + q >= max(min_length, min_exponent * q):
                found.add((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapse(words, found):
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def brute_planted(doc_id, text):
    words = WORD.findall(text or "")
    number = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if number is None or number % 10 or not words:
        return words
    g, n = number // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def some_words(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        root = [rng.choice("abc") for _ in range(rng.randint(1, 5))]
        words += root * rng.randint(1, 6) + root[: rng.randint(0, 3)]
        words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))]
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_grouping_gives_the_lyndon_array(letters):
    rng = random.Random(letters)
    for _ in range(300):
        ranks = [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
        assert runs.lyndon_array(ranks) == brute_lyndon(ranks)


@pytest.mark.parametrize("length, exponent", [(6, 4), (3, 3), (9, 3)])
def test_runs_match_brute_force(length, exponent):
    rng = random.Random(length * exponent)
    texts = [some_words(rng) for _ in range(1500)]
    found = runs.text_runs([[w.encode() for w in t] for t in texts], length, exponent)
    assert sum(map(len, found)) > 500
    for words, got in zip(texts, found, strict=True):
        assert got == brute_runs(words, length, exponent)


def test_two_roots_of_one_length_side_by_side():
    """A Lyndon word before a run of others as long must not hide the run."""
    words = "b c a b a b a b a b".split()
    assert runs.text_runs([[w.encode() for w in words]]) == [brute_runs(words)]


def test_extensions_are_checked_word_by_word(monkeypatch):
    """Even if the sums never tell words apart, the runs are right."""
    rng = random.Random(9)
    texts = [some_words(rng) for _ in range(300)]
    monkeypatch.setattr(runs, "MODULI", (3, 3))
    found = runs.text_runs([[w.encode() for w in t] for t in texts])
    assert found == [brute_runs(t) for t in texts]


def expected_row(doc_id, words):
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(found),
        *best,
        1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in found)),
        sha(brute_collapse(words, found)),
    )


def test_query_matches_brute_force(spark, tricky_rows):
    rng = random.Random(5)
    rows = [r for r in tricky_rows if len(r[1] or "") < 50_000]
    rows += [(100 + i, " ".join(some_words(rng))) for i in range(150)]
    rows += [(400 + i, "\t" + "\n\n".join(prose(i, rng.randint(1, 150)).split()) + "\x0b") for i in range(60)]
    rows += [(700, "a b " * 9), (701, "\x1c \x1c \x1c \x1c \x1c \x1c x"), (702, "A a " * 5), (703, "été " * 7)]
    docs = make_docs(spark, rows)
    out = runs.digests(runs.periodic_runs(runs.repeat_tail(docs)))
    assert Counter(map(tuple, out.collect())) == Counter(expected_row(i, brute_planted(i, t)) for i, t in rows)
    assert out.filter("n_runs > 0").count() > 50


def test_planted_tails(spark):
    rows = [(i, prose(i, 30)) for i in range(200)]
    out = {r.doc_id: r.text for r in runs.repeat_tail(make_docs(spark, rows)).collect()}
    planted = {i: " ".join(brute_planted(i, t)) for i, t in rows}
    assert out == planted and sum(out[i] != t for i, t in rows) > 5


def test_general_interface(spark):
    docs = make_docs(spark, [(1, "x y " + "go on " * 5 + "z"), (None, None)]).withColumnRenamed("doc_id", "runs")
    out = {r[0]: r for r in runs.periodic_runs(docs, id_column="runs").toDF("id", "runs", "collapsed").collect()}
    assert [tuple(r) for r in out[1].runs] == [(2, 10, 2)] and out[1].collapsed == "x y go on z"
    assert out[None].runs == [] and out[None].collapsed == ""
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, min_exponent=2)


def test_long_periodic_text(spark):
    text = " ".join(["one", "two", "three"] * 40_000)
    row = runs.periodic_runs(make_docs(spark, [(1, text)])).first()
    assert [tuple(r) for r in row.runs] == [(0, 120_000, 3)] and row.collapsed == "one two three"


def test_no_documents(no_docs):
    assert runs.digests(runs.periodic_runs(runs.repeat_tail(no_docs))).count() == 0
