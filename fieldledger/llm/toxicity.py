"""Toxicity by weak supervision.

Many voters, from word lists and from patterns, fire or stay silent on each text. A generative
two-class label model estimates from all documents' votes how often each voter fires in either
class and which voters go together; its posteriors are the labels of a linear classifier, whose
score is the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import bounded_sample, stored, text_slices

#: Labelled rows that patterns and classifier are fitted on, those of the smallest hash of id and text,
#: equal rows once.
MAX_LABELLED = 12_000
#: Patterns of toxic words, and the pattern voters they are dealt to.
MAX_PATTERNS = 8_000
PATTERN_VOTERS = 24
#: A pattern is toxic from this ratio of its rates in toxic and clean rows on, if its likelihood ratio
#: is above what about this many of all tested patterns reach by chance.
MIN_ODDS, CHANCE_FINDS = 8.0, 10
#: Word beginnings of these lengths are patterns besides whole words.
STEMS = (3, 4, 5, 6)
#: Rounds of expectation and maximisation.
EM_ROUNDS = 10
LEARNING_ROUNDS = 300

#: Word lists, one voter each.
LEXICONS = {
    "insults of mind": (
        "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "stupidity", "imbecile", "imbeciles",
        "dumb", "dumbass", "cretin", "dunce", "fool", "foolish", "dimwit", "halfwit", "brainless", "retard",
        "retarded", "simpleton",
    ),
    "insults of worth": (
        "loser", "losers", "worthless", "pathetic", "useless", "failure", "nobody", "garbage", "trash", "rubbish",
        "scum", "filth", "vermin", "parasite", "waste", "lowlife",
    ),
    "insults of looks": (
        "ugly", "fat", "fatso", "disgusting", "hideous", "repulsive", "gross", "pig", "cow", "freak",
    ),
    "mockery": (
        "clown", "clowns", "joke", "laughable", "ridiculous", "buffoon", "crybaby", "snowflake", "wimp", "coward",
        "cowards",
    ),
    "swearing": (
        "damn", "bastard", "bastards", "bitch", "bitches", "shit", "shitty", "crap", "fuck", "fucking", "fucker",
        "asshole", "arsehole", "dick", "prick", "cunt", "whore", "slut", "bollocks", "wanker",
    ),
    "threats": (
        "kill", "die", "hang", "shoot", "stab", "burn", "beat", "destroy", "hurt", "punish",
    ),
    "german": (
        "idiot", "idioten", "dumm", "dummkopf", "trottel", "depp", "arschloch", "scheisse", "scheiße", "hurensohn",
        "abschaum", "versager", "dreck", "drecksack", "wichser", "schlampe", "blöd", "wertlos", "widerlich",
    ),
    "french": (
        "idiot", "idiote", "imbécile", "crétin", "connard", "connasse", "salaud", "salope", "merde", "con", "conne",
        "abruti", "débile", "ordure", "minable", "dégoûtant", "bâtard", "pute",
    ),
    "spanish": (
        "idiota", "imbécil", "estúpido", "estúpida", "tonto", "tonta", "cabrón", "mierda", "puta", "gilipollas",
        "basura", "asqueroso", "inútil", "perdedor", "pendejo", "escoria",
    ),
}
#: Patterns of the text as a whole, one voter each.
SHAPES = {
    "named to the face": r"\b(?:you|your|u)\b(?: \w+){0,3} (?:idiot|moron|loser|clown|fool|scum|trash)\b",
    "shut up": r"\bshut (?:the \w+ )?up\b|\bgo (?:to hell|away|die)\b",
    "hate": r"\b(?:i|we|they) (?:hate|despise|loathe)\b",
    "shouting": r"(?:\b[A-Z]{4,}\b\W+){3}",
    "marks": r"[!?]{3,}",
    "masked word": r"\b\w+[*@#$]{2,}\w+\b",
}

_WORD = re.compile(r"[^\W\d_]+")
_SHAPES = {name: re.compile(p) for name, p in SHAPES.items()}
_FACE = frozenset(("you", "your", "u"))
_NAMES = frozenset(("idiot", "moron", "loser", "clown", "fool", "scum", "trash"))
_HATE = frozenset(("hate", "despise", "loathe"))
_ORDER = frozenset(("shut", "go"))
_CAPITALS, _MARKS, _MASKS = re.compile("[A-Z]{4}"), re.compile("[!?]{3}"), re.compile("[*@#$]{2}")
VOTERS = [*LEXICONS, *SHAPES, *(f"patterns {i}" for i in range(PATTERN_VOTERS))]


def words_of(text: str) -> set[str]:
    """Distinct runs of letters, in lower case."""
    out = set()
    for piece in set(text.lower().split()):
        if piece.isalpha():
            out.add(piece)
        else:
            out.update(_WORD.findall(piece))
    return out


def shapes_of(text: str, words: set[str]) -> list[bool]:
    """Which SHAPES a text has; each is searched only where its words or marks occur at all."""

    def said(name: str) -> bool:
        return _SHAPES[name].search(text.lower()) is not None

    return [
        not _FACE.isdisjoint(words) and not _NAMES.isdisjoint(words) and said("named to the face"),
        not _ORDER.isdisjoint(words) and said("shut up"),
        not _HATE.isdisjoint(words) and said("hate"),
        _CAPITALS.search(text) is not None and _SHAPES["shouting"].search(text) is not None,
        _MARKS.search(text) is not None,
        _MASKS.search(text) is not None and _SHAPES["masked word"].search(text) is not None,
    ]


def patterns_of(words: Iterable[str]) -> set[str]:
    """Whole words (``=word``) and word beginnings (``word-``)."""
    out = set()
    for w in words:
        out.add("=" + w)
        out.update(w[:n] + "-" for n in STEMS if len(w) > n)
    return out


@dataclass
class Patterns:
    """Toxic patterns by number; ``starts`` are the first letters some pattern begins with."""

    number: dict[str, int]

    def __post_init__(self) -> None:
        self.starts = {p.strip("=-")[: STEMS[0]] for p in self.number}

    def found(self, words: Iterable[str]) -> set[int]:
        out = set()
        for w in words:
            if w[: STEMS[0]] in self.starts:
                for p in ("=" + w, *(w[:n] + "-" for n in STEMS if len(w) > n)):
                    at = self.number.get(p)
                    if at is not None:
                        out.add(at)
        return out


def labelled_rows(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """doc_id, text, toxic of at most MAX_LABELLED labelled rows, equal ones once; ``usable`` picks
    among the labels."""
    chosen = (
        labels.filter(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return bounded_sample(rows, ["doc_id", "text"], MAX_LABELLED)


def _count_patterns(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in text_slices(batches, chars=4_000_000):
        toxic, clean = Counter(), Counter()
        for text, label in zip(rows.text, rows.toxic, strict=True):
            (toxic if label else clean).update(patterns_of(words_of(text)))
        names = sorted(toxic.keys() | clean.keys())
        yield pd.DataFrame({"pattern": names, "toxic": [toxic[n] for n in names], "clean": [clean[n] for n in names]})


def mine_patterns(sample: DataFrame) -> Patterns:
    """Word patterns that toxic rows have far more often than clean ones; at most MAX_PATTERNS."""
    totals = sample.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    t, c = max(1, totals.t), max(1, totals.c)
    k, n, q = F.col("toxic"), F.col("toxic") + F.col("clean"), t / (t + c)
    # Likelihood ratio against the pattern being as frequent in both classes.
    surprise = 2 * (k * F.log(k / (n * q)) + F.when(k < n, (n - k) * F.log((n - k) / (n * (1 - q)))).otherwise(0.0))
    odds = ((k + 0.1) / t) / ((F.col("clean") + 0.1) / c)
    tested = stored(
        sample.mapInPandas(_count_patterns, "pattern string, toxic long, clean long")
        .groupBy("pattern")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= 2),
        "patterns",
    )
    least = 2 * math.log(max(1.0, tested.count() / CHANCE_FINDS))
    best = (
        tested.filter((odds >= MIN_ODDS) & (surprise >= least))
        .orderBy(surprise.desc(), "pattern")
        .limit(MAX_PATTERNS)
        .select("pattern")
        .toPandas()
    )
    return Patterns({p: i for i, p in enumerate(best.pattern)})


def vote(text: str, words: set[str], found: set[int]) -> int:
    """Bits of the voters that fire."""
    bits = 0
    for i, lexicon in enumerate(LEXICON_SETS):
        if not lexicon.isdisjoint(words):
            bits |= 1 << i
    for i, there in enumerate(shapes_of(text, words)):
        bits |= there << (len(LEXICON_SETS) + i)
    for p in found:
        bits |= 1 << (len(LEXICON_SETS) + len(_SHAPES) + p % PATTERN_VOTERS)
    return bits


LEXICON_SETS = [frozenset(words) for words in LEXICONS.values()]


def _vote_batches(patterns) -> Callable:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = patterns.value
        for rows in text_slices(batches):
            votes = Counter()
            for text, label in zip(rows.text, rows.toxic.fillna(-1).astype(int), strict=True):
                words = words_of(text)
                votes[vote(text, words, known.found(words)), label] += 1
            yield pd.DataFrame([(v, y, n) for (v, y), n in votes.items()], columns=["votes", "label", "n"])

    return run


@dataclass
class LabelModel:
    """Bias and weight per voter of the posterior log odds."""

    bias: float
    fire: np.ndarray
    silent: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = _bits(votes)
        z = self.bias + on @ self.fire + (1 - on) @ self.silent
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bits(votes: np.ndarray) -> np.ndarray:
    return ((np.asarray(votes, dtype=np.int64)[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)


def _moments(model: LabelModel, pairs: bool) -> Callable:
    """Task function: expected counts of class, class and vote, and (``pairs``) class and two votes."""
    m = len(VOTERS)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * (1 + m + m * m * pairs))
        for b in batches:
            on, n = _bits(b.votes.to_numpy()), b.n.to_numpy(dtype=float)
            p = np.where(b.label >= 0, b.label, model.posterior(b.votes.to_numpy()))
            for y, w in ((0, (1 - p) * n), (1, p * n)):
                part = [np.array([w.sum()]), w @ on]
                if pairs:
                    part.append((on.T @ (on * w[:, None])).ravel())
                half = len(total) // 2
                total[y * half : (y + 1) * half] += np.concatenate(part)
        yield pd.DataFrame({"at": np.arange(len(total)), "value": total})

    return run


def _collect_moments(votes: DataFrame, model: LabelModel, pairs: bool = False) -> np.ndarray:
    rows = (
        votes.mapInPandas(_moments(model, pairs), "at int, value double").groupBy("at").agg(F.sum("value").alias("v"))
    ).toPandas()
    size = 2 * (1 + len(VOTERS) * (1 + len(VOTERS) * pairs))
    out = np.zeros(size)
    out[rows["at"].to_numpy(dtype=int)] = rows.v.to_numpy()
    return out.reshape(2, -1)


def _model(moments: np.ndarray, discount: np.ndarray) -> LabelModel:
    count = moments[:, 0] + 1
    rate = (moments[:, 1 : 1 + len(VOTERS)] + 0.5) / count[:, None]
    rate = np.clip(rate, 1e-6, 1 - 1e-6)
    return LabelModel(
        float(np.log(count[1] / count[0])),
        np.log(rate[1] / rate[0]) / discount,
        np.log((1 - rate[1]) / (1 - rate[0])) / discount,
    )


def shared_evidence(moments: np.ndarray) -> np.ndarray:
    """One plus the summed dependence of each voter on the others.

    If voters only agree because of the class, their covariances are a_i x a_j. Each a_i is the
    lower quartile over pairs j, k of cov_ij cov_ik / cov_jk, which dependent pairs only raise; what
    a pair's covariance has above a_i x a_j, as a correlation of 0.1 or more, is their dependence.
    """
    m = len(VOTERS)
    both = moments.sum(axis=0)
    total = both[0] + 1
    rate, joint = both[1 : 1 + m] / total, both[1 + m :].reshape(m, m) / total
    cov = joint - np.outer(rate, rate)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    alive = np.flatnonzero(spread > 0)
    pull = np.zeros(m)
    for i in alive:
        others = alive[alive != i]
        j, k = (others[x] for x in np.triu_indices(len(others), 1))
        sure = cov[j, k] > 1e-9
        if sure.any():
            pull[i] = np.sqrt(max(0.0, np.quantile((cov[i, j] * cov[i, k])[sure] / cov[j, k][sure], 0.25)))
    scale = np.outer(spread, spread) + 1e-12
    extra = np.clip((cov - np.outer(pull, pull)) / scale, 0, 1)
    np.fill_diagonal(extra, 0)
    extra[extra < 0.1] = 0
    return 1 + extra.sum(axis=1)


def fit_label_model(votes: DataFrame) -> LabelModel:
    """Two-class label model of the vote counts (votes, label or -1, n), by EM.

    The voters' dependences are measured first; in all posteriors a voter's evidence is divided by
    one plus its dependence, so that voters that repeat each other don't count twice. Rows with a
    label keep it. The start takes every voter for a little toxic. Each round is one aggregate of a
    fixed number of sums.
    """
    m = len(VOTERS)
    model = LabelModel(-2.5, np.full(m, 1.5), np.full(m, -0.05))
    discount = shared_evidence(_collect_moments(votes, model, pairs=True))
    model = LabelModel(model.bias, model.fire / discount, model.silent / discount)
    for _ in range(EM_ROUNDS):
        model = _model(_collect_moments(votes, model), discount)
    return model


def _sample_features(patterns) -> Callable:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = patterns.value
        for rows in text_slices(batches):
            out = []
            for text, label in zip(rows.text, rows.toxic, strict=True):
                words = words_of(text)
                found = known.found(words)
                out.append((label, vote(text, words, found), sorted(found)))
            yield pd.DataFrame(out, columns=["toxic", "votes", "found"])

    return run


@dataclass
class Classifier:
    """Logistic regression on the patterns and voters found in a text."""

    bias: float
    patterns: np.ndarray
    voters: np.ndarray

    def score(self, votes: int, found: Iterable[int]) -> float:
        z = self.bias + sum(self.patterns[p] for p in found)
        z += sum(w for i, w in enumerate(self.voters) if votes >> i & 1)
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def train_classifier(features: pd.DataFrame, target: np.ndarray, patterns: int, reg: float = 1e-4) -> Classifier:
    """Logistic loss on at most MAX_LABELLED rows, minimised by full-batch steps scaled per weight."""
    rows = np.repeat(np.arange(len(features)), features.found.str.len().to_numpy(dtype=int))
    cols = np.concatenate([*features.found, np.empty(0)]).astype(int)
    on = _bits(features.votes.to_numpy())
    n = max(1, len(features))
    w = np.zeros(patterns + on.shape[1] + 1)
    w[-1] = np.log((target.sum() + 0.5) / (n - target.sum() + 0.5))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, LEARNING_ROUNDS + 1):
        z = w[-1] + np.bincount(rows, weights=w[cols], minlength=n)[: len(on)] + on @ w[patterns:-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.concatenate([np.bincount(cols, weights=error[rows], minlength=patterns), on.T @ error, [error.sum()]])
        grad[:-1] += reg * w[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w -= 0.1 * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
        w[:-1] = np.maximum(0, w[:-1])  # a voter is never evidence of cleanness
    return Classifier(float(w[-1]), w[:patterns], w[patterns:-1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[Patterns, LabelModel, Classifier]:
    """Patterns, label model and classifier. Labels are read only where ``usable`` holds."""
    spark = docs.sparkSession
    sample = stored(labelled_rows(docs, labels, usable), "labelled")
    patterns = mine_patterns(sample)
    shared = spark.sparkContext.broadcast(patterns)
    known = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    voted = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left").select("text", "toxic")
    votes = voted.mapInPandas(_vote_batches(shared), "votes long, label int, n long")
    votes = stored(votes.groupBy("votes", "label").agg(F.sum("n").alias("n")), "votes")
    model = fit_label_model(votes)
    features = sample.mapInPandas(_sample_features(shared), "toxic int, votes long, found array<int>").toPandas()
    posterior = np.where(features.toxic.isin([0, 1]), features.toxic, 0) if features.empty else model.posterior(features.votes.to_numpy())
    # A posterior label against the row's own label is worth half. Posteriors alone, be it of these
    # rows or of a sample of all documents, were measured to be worse on the held-out fold (README).
    target = 0.5 * (posterior + features.toxic.to_numpy(dtype=float)) if len(features) else np.empty(0)
    return patterns, model, train_classifier(features, target, len(patterns.number))


def score_column(docs: DataFrame, patterns: Patterns, classifier: Classifier, text: str = "text") -> Column:
    """Score of a text, a double from 0 to 1. A null or empty text gets the score of one in which
    nothing is found."""
    shared = docs.sparkSession.sparkContext.broadcast((patterns, classifier))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, model = shared.value
        for texts in batches:
            scores = []
            for t in texts:
                words = words_of(t if isinstance(t, str) else "")
                found = known.found(words)
                scores.append(model.score(vote(t or "", words, found), found))
            yield pd.Series(scores, dtype="float64")

    return F.pandas_udf(score, "double")(F.col(text))
