import random
import zlib

import corpus_pipeline
from fieldledger.llm.common import label_fold
from tests.llm.conftest import make_docs, prose
from tests.llm.test_dart_minhash import brute_classes, mutated
from tests.llm.test_sharding_dedup import brute_shard
from tests.llm.test_spaced_seeds import brute

INSULTS = ["idiot", "moron", "loser", "worthless", "pathetic"]


def build(spark, folder):
    """A small table with toxic rows, near copies and benchmark passages, and what should become of it."""
    rng = random.Random(11)
    items = [(k, prose(500 + k, 30)) for k in range(4)]
    docs, toxic = [], {}
    for i in range(240):
        words = prose(i, rng.randint(30, 120)).split()
        if i % 8 == 3:
            for w in rng.sample(INSULTS, 3):
                words.insert(rng.randrange(len(words)), w)
        if i % 2 == 1:
            toxic[i] = int(i % 8 == 3)
        if i % 15 == 1:
            words[10:10] = items[i % 4][1].split()
        docs.append((i, " ".join(words)))
    for i in range(0, 40, 2):
        docs.append((1000 + i, mutated(docs[i][1] if i % 8 != 3 else docs[0][1], rng, 1)))
    docs += [(2000, None), (2001, ""), (None, prose(9999, 50))]
    frame = make_docs(spark, docs)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").selectExpr("doc_id", "1 as quality", "toxic").write.parquet(
        f"{folder}/labels.parquet"
    )
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = build(spark, folder)
    assert label_fold is not None and zlib.crc32(b"1") % 5 in range(5)
    left = spark.read.parquet(f"{folder}/documents.parquet")
    columns = left.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]

    left = stages["toxicity"](spark, left, folder)
    rows = [(r.doc_id, r.text) for r in left.collect()]
    gone = {i for i, _ in docs} - {i for i, _ in rows}
    assert gone == {i for i, t in docs if t and any(w in t.split() for w in INSULTS)}

    left = stages["near_dedup"](spark, left, folder)
    kept = {r.doc_id for r in left.collect()}
    assert kept == {min((rows[m][0] for m in c if rows[m][0] is not None), default=None) for c in brute_classes(rows)}

    rows = [(r.doc_id, r.text) for r in left.collect()]
    left = stages["decontamination"](spark, left, folder)
    assert {r.doc_id for r in left.collect()} == kept - {d for d, _ in brute(rows, items) if d is not None}

    before = {r.doc_id for r in left.collect()}
    left = stages["mixing"](spark, left, folder)
    assert left.columns == columns
    mixed = [r.doc_id for r in left.collect()]
    assert set(mixed) <= before and len(mixed) == len(set(mixed))

    for r in stages["sharding"](spark, left, folder).collect():
        assert r.shard == brute_shard(r.doc_id, [1.0] * corpus_pipeline.SHARDS)


def test_whole_run(spark, tmp_path):
    folder = str(tmp_path)
    docs, _ = build(spark, folder)
    out = corpus_pipeline.run(spark, folder)
    assert 0 < out.count() < len(docs)


def test_no_documents(spark, tmp_path):
    folder = str(tmp_path)
    build(spark, folder)
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
        assert empty.count() == 0, name
