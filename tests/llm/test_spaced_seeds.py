import itertools
import random

import numpy as np

from fieldledger.llm.spaced_seeds import MASKS, best_overlap, clean_documents, counts_as_overlap, find_overlaps, tokens_of
from tests.llm.conftest import make_docs, prose


def test_masks_hit_every_passage_of_the_limit():
    """However a fifth of 13 to 17 words are chosen for substitution, some mask's window stays whole."""
    for words in range(13, 18):
        windows = [
            {s + i for i, c in enumerate(m) if c == "1"} for m in MASKS for s in range(words - len(m) + 1)
        ]
        for sub in itertools.combinations(range(words), words // 5):
            assert any(not (w & set(sub)) for w in windows)


def brute(docs, items):
    found = set()
    for d, text in docs:
        td, _ = tokens_of([text or ""])
        for k, item in items:
            ti, _ = tokens_of([item or ""])
            for shift in range(-len(ti) + 1, len(td)):
                _, _, n, same = best_overlap(td, ti, shift)
                if len(ti) >= 5 and counts_as_overlap(n, same, len(ti)):
                    found.add((d, k))
    return found


def test_overlaps_match_brute_force(spark):
    rng = random.Random(5)
    items = [(k, prose(100 + k, rng.randint(5, 40))) for k in range(12)] + [(12, ""), (13, None), (14, "two words")]
    docs = []
    for d in range(60):
        words = prose(d, rng.randint(0, 120)).split()
        if d % 2:
            passage = items[d % 12][1].split()
            for _ in range(rng.randint(0, len(passage) // 4)):
                passage[rng.randrange(len(passage))] = "changed"
            if d % 5 == 0:  # a part of it only
                passage = passage[: rng.randint(1, len(passage))]
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((d, " ".join(words).title()))
    docs += [(100, None), (101, ""), (102, items[3][1] + " " + items[4][1]), (102, items[3][1])]
    frame = make_docs(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = find_overlaps(frame, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got == brute(docs, items)
    assert len(got) == len(rows)
    left = {r.doc_id for r in clean_documents(frame, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}
    assert clean_documents(frame, bench).columns == frame.columns


def test_long_passage_in_a_long_text(spark):
    item = prose(7, 300)
    words = prose(8, 30_000).split()
    words[20_000:20_000] = item.split()
    rows = find_overlaps(
        make_docs(spark, [(1, " ".join(words)), (2, prose(9, 500)), (None, item)]),
        spark.createDataFrame([(1, item)], "item_id long, text string"),
    ).collect()
    assert {(r.doc_id, r.doc_start, r.item_start, r.tokens) for r in rows} == {(1, 20_000, 0, 300), (None, 0, 0, 300)}


def test_empty_tables(spark, no_docs, tricky):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_overlaps(tricky, bench).count() == 0
    assert find_overlaps(no_docs, spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")).count() == 0
    assert clean_documents(tricky, bench).count() == tricky.count()


def test_best_overlap_is_the_longest_within_the_share():
    a = np.array([1, 2, 3, 4, 9, 6, 7, 8], dtype=np.int64)
    b = np.array([1, 2, 3, 4, 5, 6, 7, 8], dtype=np.int64)
    assert best_overlap(a, b, 0) == (0, 0, 8, 7)


def test_items_and_documents_without_or_with_shared_ids(spark):
    item, other = prose(700, 30), prose(701, 30)
    docs = make_docs(spark, [(1, "x " + item), (1, prose(702, 20)), (None, item), (None, prose(703, 9)), (2, other), (3, None)])
    bench = spark.createDataFrame([(None, item), (5, other), (5, prose(704, 20))], "item_id long, text string")
    rows = find_overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, None), (None, None), (2, 5)}
    left = {(r.doc_id, r.text) for r in clean_documents(docs, bench).collect()}
    assert left == {(1, prose(702, 20)), (None, prose(703, 9)), (3, None)}


def test_items_too_short_for_a_window(spark):
    """They match the documents that are their words and nothing else."""
    bench = spark.createDataFrame([(1, "Yes, indeed!"), (2, "no"), (3, "...")], "item_id long, text string")
    docs = make_docs(spark, [(1, "yes indeed"), (2, "yes indeed it is"), (3, "No."), (4, "no no"), (5, "..."), (6, prose(1, 50) + " no")])
    assert {(r.doc_id, r.item_id) for r in find_overlaps(docs, bench).collect()} == {(1, 1), (3, 2)}
    assert {r.doc_id for r in clean_documents(docs, bench).collect()} == {2, 4, 5, 6}
