import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldledger.llm import mixing, toxicity
from fieldledger.llm.common import label_fold
from tests.llm.conftest import make_docs, prose

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, toxic int, text string"


def test_held_out_accuracy(spark):
    from fieldledger.llm.queries import op7_toxicity

    rows = op7_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    right = np.mean([r.predicted == r.toxic for r in rows])
    assert right >= 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.predicted and not r.toxic for r in rows)


def test_held_out_labels_are_never_read(spark):
    """Scores don't move when the labels of the held-out fold are turned around."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = label_fold(F.col("doc_id")) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = []
    for some in (labels, turned):
        patterns, _, classifier = toxicity.fit(docs, some, ~held)
        scores.append({r.doc_id: r.s for r in docs.select("doc_id", toxicity.score_column(docs, patterns, classifier).alias("s")).collect()})
    assert scores[0] == scores[1]


def test_label_model_recovers_voters(spark):
    """Votes drawn from known rates, one voter twice, a tenth of the rows labelled: posteriors find
    the class, and the doubled voter is seen."""
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    votes = np.zeros(len(y), dtype=np.int64)
    rates = {0: (0.6, 0.02), 1: (0.5, 0.03), 2: (0.4, 0.01), 3: (0.5, 0.5), 5: (0.55, 0.02)}
    for j, (t, c) in rates.items():
        fires = rng.random(len(y)) < np.where(y, t, c)
        votes |= fires.astype(np.int64) << j
        if j == 5:
            votes |= fires.astype(np.int64) << 6
    label = np.where(np.arange(len(y)) % 10 == 0, y, -1).astype(int)
    frame = pd.DataFrame({"votes": votes, "label": label}).value_counts().reset_index(name="n")
    model = toxicity.fit_label_model(spark.createDataFrame(frame, "votes long, label int, n long"))
    p = model.posterior(votes)
    assert np.mean((p >= 0.5) == y) > 0.91
    assert abs(model.fire[3]) < 0.2  # fires as often in either class
    start = toxicity.LabelModel(0.0, np.zeros(len(toxicity.VOTERS)), np.zeros(len(toxicity.VOTERS)))
    part = next(iter(toxicity._moments(start, True)([frame])))
    shared = toxicity.shared_evidence(part.value.to_numpy().reshape(2, -1))
    assert shared[5] > 1.8 and shared[6] > 1.8 and shared[3] == 1


def test_odd_documents_and_no_labels(spark, tricky, no_docs, tricky_rows):
    none = spark.createDataFrame([], LABELS)
    usable = label_fold(F.col("doc_id")) != 0
    patterns, _, classifier = toxicity.fit(tricky, none, usable)
    out = tricky.withColumn("score", toxicity.score_column(tricky, patterns, classifier)).collect()
    assert len(out) == len(tricky_rows) and all(0 <= r.score < 0.5 for r in out)
    odd = spark.createDataFrame([(None, 1, "x"), (3, None, "x"), (4, 1, "x"), (9, 0, "x"), (9, 1, "x"), (77, 1, "x"), (1, 5, "x")], LABELS)
    patterns, _, classifier = toxicity.fit(tricky, odd, usable)
    assert tricky.select(toxicity.score_column(tricky, patterns, classifier).alias("s")).filter("s between 0 and 1").count() == len(tricky_rows)
    patterns, _, classifier = toxicity.fit(no_docs, odd, usable)
    assert no_docs.select(toxicity.score_column(no_docs, patterns, classifier)).count() == 0


def brute_rates(p, tokens, wanted, ceiling=np.inf, rounds=4_000):
    """The same problem by plain projected gradient with a small step."""
    supply = (tokens[:, None] * p).sum(0)
    rate = np.minimum(np.ones(len(p)), ceiling)
    for _ in range(rounds):
        error = ((rate[:, None] * tokens[:, None] * p).sum(0) - wanted) / supply
        rate = np.clip(rate - 0.05 * p @ error, 0, ceiling)
    return rate, (rate[:, None] * tokens[:, None] * p).sum(0)


@pytest.mark.parametrize("ceiling", [None, 1.0])
def test_rates_meet_the_targets(spark, ceiling):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.15, 0.1, 0.05], 300)
    tokens = rng.integers(0, 900, 300)
    members = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "tokens long, p array<double>")
    targets = {"a": 2.0, "b": 3.0, "c": 1.0}
    budget = 1.0 if ceiling is None else 0.7
    fitted = mixing.fit_rates(members, list(targets), targets, budget, ceiling)
    rows = members.select("tokens", "p", mixing.rate_column(F.col("p"), fitted.steps, ceiling).alias("r")).collect()
    got = sum(np.array(r.p) * r.tokens * r.r for r in rows)
    wanted = fitted.budget * tokens.sum() * np.array([2, 3, 1]) / 6
    assert fitted.budget <= budget and np.allclose(fitted.wanted, wanted) and np.allclose(fitted.reached, got)
    assert fitted.converged == bool(np.all(abs(got - wanted) <= 1.001 * mixing.TOLERANCE * tokens.sum()))
    assert fitted.converged or ceiling is not None
    if ceiling is not None:  # as much as the scarcest domain allows
        share = np.array([2, 3, 1]) / 6
        scarcest = ((tokens[:, None] * p).sum(0) / (share * tokens.sum())).min()
        assert np.isclose(fitted.budget, min(budget, mixing.SUPPLY_SHARE * scarcest))
    _, best = brute_rates(p, tokens, wanted, np.inf if ceiling is None else ceiling)
    supply = (tokens[:, None] * p).sum(0)
    loss = lambda t: (((t - wanted) ** 2) / supply).sum() / tokens.sum()
    assert all(r.r >= 0 and (ceiling is None or r.r <= ceiling) for r in rows)
    assert loss(got) <= loss(best) + 3e-4
    if ceiling is None:
        assert np.allclose(got, wanted, rtol=0.01)


def test_mixture_of_languages(spark):
    from fieldledger.llm.queries import MIX_TARGETS, op8_soft_mixing

    rows = op8_soft_mixing(spark, SF).toPandas()
    p = rows[[f"p_{d}" for d in MIX_TARGETS]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (rows.rate >= 0).all()
    share = (rows.expected_tokens.to_numpy()[:, None] * p).sum(0) / rows.tokens.sum()
    assert np.allclose(share, list(MIX_TARGETS.values()), atol=0.01)
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    guess = np.array(list(MIX_TARGETS))[p.argmax(axis=1)]
    assert np.mean(guess == docs.lang[rows.doc_id].to_numpy()) > 0.95
    assert (rows.copies - rows.rate).abs().max() < 1
    assert abs(rows.copies.mean() - rows.rate.mean()) < 0.05


def test_odd_mixtures(spark, tricky, no_docs, tricky_rows):
    """One labelled domain or none, null texts, an empty table, and clashing columns."""
    labels = spark.createDataFrame([(9, 0, "x"), (4, 1, "x")], LABELS)
    for labelled in (
        mixing.choose_labelled(tricky, labels, F.col("lang")),
        mixing.choose_labelled(tricky, labels.limit(0), F.col("lang")),
        mixing.choose_labelled(tricky, labels, F.when(F.length("text") > 1000, "de").otherwise("en")),
    ):
        mixture, members = mixing.fit_mixture(tricky, labelled, {"en": 1.0, "de": 1.0})
        assert members.count() == len(tricky_rows)
        out = mixing.sampled(tricky, mixture)
        assert out.columns == tricky.columns
        assert {r.doc_id for r in out.collect()} <= {i for i, _ in tricky_rows}
    mixture, members = mixing.fit_mixture(no_docs, labelled, {"en": 1.0, "de": 1.0})
    assert members.count() == 0 and mixing.sampled(no_docs, mixture).count() == 0


def test_copies_follow_the_rate(spark):
    n = 20_000
    rows = spark.range(n).select(mixing.copies_column(F.lit(1.3), F.xxhash64("id")).alias("c")).groupBy("c").count().collect()
    counts = {r.c: r["count"] for r in rows}
    assert set(counts) == {1, 2} and abs(counts[2] / n - 0.3) < 0.02


def test_pipeline_meets_its_targets(spark):
    """Expected tokens by predicted and by true language, without repeating a document."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = mixing.choose_labelled(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.col("lang"))
    targets = corpus_pipeline.TARGETS
    mixture, members = mixing.fit_mixture(docs, labelled, targets, corpus_pipeline.BUDGET, max_rate=1.0)
    assert mixture.fitted.converged
    rate = mixture.rate(F.col("p"))
    rows = members.join(docs.select("doc_id", "lang"), "doc_id").select("lang", "tokens", rate.alias("rate")).toPandas()
    assert rows.rate.max() <= 1
    tokens = (rows.tokens * rows.rate).groupby(rows.lang).sum()
    for language, share in targets.items():
        assert abs(tokens[language] / tokens.sum() - share) < 0.01


def test_sample_is_bounded_and_holds_no_row_twice(spark, monkeypatch):
    """An id that most rows carry does not multiply the labelled rows."""
    from fieldledger.llm.common import bounded_sample

    docs = make_docs(spark, [(7, "same text")] * 500 + [(7, f"text {i}") for i in range(500)] + [(None, "x")])
    labels = spark.createDataFrame([(7, 1, "x")], LABELS)
    assert bounded_sample(docs, ["doc_id", "text"], 40).count() == 40
    assert bounded_sample(docs, ["doc_id", "text"], 4_000).count() == 502
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 30)
    assert toxicity.labelled_rows(docs, labels, F.lit(True)).count() == 30
