import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fieldledger.llm.exact_dedup import exact_duplicates, frequent_digests
from fieldledger.llm.sharding import assign_shards, with_shards


def brute_shard(key, weights):
    import math

    def score(i):
        h = int(hashlib.md5(f"{'null' if key is None else key}#{i}".encode()).hexdigest()[:13], 16)
        return h if len(set(weights)) == 1 else -weights[i] / math.log((h + 0.5) / 2**52)

    return max(range(len(weights)), key=lambda i: (score(i), -i))


def test_shards_follow_the_law(spark, tricky, tricky_rows):
    rows = assign_shards(tricky, 5).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in tricky_rows)
    slots = defaultdict(list)
    texts = defaultdict(list)
    for i, t in tricky_rows:
        texts[i].append((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    for r in rows:
        assert r.shard == brute_shard(r.doc_id, [1.0] * 5)
        assert r.grown_shard == brute_shard(r.doc_id, [1.0] * 6)
        assert r.grown_shard in (r.shard, 5)
        assert (r["size"], r.text_crc32) in texts[r.doc_id]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weighted_shards_share_and_move_little(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    weights = [1.0, 2.0, 4.0, 1.0]
    rows = assign_shards(docs, 4, weights=weights, grown_weight=2.0).collect()
    for r in rows[:200]:
        assert r.shard == brute_shard(r.doc_id, weights) and r.grown_shard == brute_shard(r.doc_id, [*weights, 2.0])
    share = Counter(r.shard for r in rows)
    assert all(abs(share[i] / 4000 - w / 8) < 0.03 for i, w in enumerate(weights))
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert all(r.grown_shard == 4 for r in moved) and abs(len(moved) / 4000 - 0.2) < 0.03


def test_no_documents(no_docs):
    assert assign_shards(no_docs, 4).count() == 0
    assert exact_duplicates(no_docs).count() == 0


def test_clashing_shard_column_is_replaced(tricky):
    out = with_shards(tricky, 3)
    assert dict(out.dtypes)["shard"] == "int" and out.count() == tricky.count()


def test_exact_copies(tricky, tricky_rows):
    rows = exact_duplicates(tricky).collect()
    groups = defaultdict(list)
    for i, t in tricky_rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert Counter((r.doc_id, r.text_sha256) for r in rows) == Counter((i, h) for h, m in groups.items() for i in m)
    kept = Counter()
    for r in rows:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert r.group_size == len(groups[r.text_sha256]) and r.keep_id == max(ids, default=None)
        if r.kept:
            kept[r.text_sha256] += 1
            assert r.doc_id == r.keep_id
    assert kept == dict.fromkeys(groups, 1)


def test_heavy_digests_are_verified(spark):
    """A third of the rows are copies of one text; all others differ."""
    docs = spark.range(0, 9000, 1, 12).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"),
    )
    digests = docs.select(
        F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    ).withColumn("rid", F.col("id"))
    heavy = frequent_digests(digests).collect()
    assert [(r.group_size, r.keep_id) for r in heavy] == [(3000, 8997)]
    out = exact_duplicates(docs)
    assert out.filter("kept").count() == 6001
    assert out.filter("group_size = 3000 AND keep_id = 8997").count() == 3000
