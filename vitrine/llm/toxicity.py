"""Toxicity as severity grades by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector shared by ascending
thresholds. Features are sparse: log counts of the words
and word beginnings whose log-odds between
toxic and clean labelled texts are farthest from zero by
their lower confidence bound, and the log length. The output is the
expected severity, sum of k * P(grade = k).

Labels are binary, so the grades of the toxic fit rows come from the text: the
sum of log counts of the features that are typical of toxic rows, cut at its
terciles into grades 1 to 3; clean rows have grade 0. The fit sees a bounded sample of labelled rows;
every row of the documents is scored, over its whole text.

Defined cases: a null text scores like an empty one; ids may be null or repeat,
each row is scored by itself; labels with null or without a document are
ignored; without any toxic or any clean label every text scores 0; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import cut
from vitrine.session import ship_package

SAMPLE_ROWS = 4_000             # labelled rows of each class in the fit, about: the bound of the fit
FEATURES = 300
MIN_ROWS = 6                    # rows that hold a feature word, at least
GRADES = 3                      # above zero
ROUNDS, RIDGE = 40, 0.3
STEMS = (4, 5)                  # word beginnings that are features, too
SEED = 3

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def feature_counts(text: str | None) -> tuple[int, Counter]:
    """The number of words of a text, and its features."""
    found = Counter(_WORD.findall((text or "").lower()))
    out: Counter = Counter()
    for word, n in found.items():
        for f in features_of(word):
            out[f] += n
    return sum(found.values()), out


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)         # word -> column
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, np.inf))

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, P(grade >= 1)) of each text."""
        eta = np.zeros(len(texts))
        words, heads = self.words, {n: {w[:n] for w in self.words if w.endswith("*") and len(w) == n + 1} for n in STEMS}
        for k, text in enumerate(texts):
            found = _WORD.findall((text or "").lower())
            eta[k] = self.weights[-1] * length_feature(len(found))
            counts = Counter(filter(words.__contains__, found))
            for n, known in heads.items():
                counts.update(h + "*" for h in filter(known.__contains__, [w[:n] for w in found]))
            for w, n in counts.items():
                eta[k] += self.weights[words[w]] * np.log1p(n)
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -500, 500)))
        above = np.where(np.isinf(self.thresholds)[None, :], 0.0, above)
        return above.sum(1), above[:, 0]


def length_feature(n_words: int) -> float:
    return float(np.log1p(n_words) / 10)


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, ridge: float = RIDGE,
                rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds: Newton steps, halved until they lower
    the negative log-likelihood plus ridge / 2 * |w|^2, which is convex."""
    n, d = x.shape
    seen = np.array([(y <= k).sum() for k in range(grades)])
    share = (seen + np.arange(1, grades + 1)) / (n + grades + 1)
    beta = np.concatenate((np.zeros(d), np.log(share / (1 - share))))
    steps = np.eye(grades)
    below_top, above_bottom = y < grades, y > 0
    upper = np.concatenate([-x, steps[np.minimum(y, grades - 1)]], 1)[below_top]        # threshold_y - w.x
    lower = np.concatenate([-x, steps[np.maximum(y, 1) - 1]], 1)[above_bottom]          # the threshold below
    between = np.bincount(y, minlength=grades + 1)[1:grades]
    gaps = np.concatenate([np.zeros((grades - 1, d)), steps[1:] - steps[:-1]], 1)
    penalty = np.concatenate((np.full(d, ridge), np.full(grades, 1e-6)))

    def sigmoid(v):
        return 1 / (1 + np.exp(np.clip(-v, -500, 500)))

    # log P = log sigmoid(upper) + log sigmoid(-lower) + log(1 - exp(-gap)): each term is concave
    def loss_of(b):
        gap = gaps @ b
        if (gap <= 0).any():
            return np.inf
        return (np.logaddexp(0, -(upper @ b)).sum() + np.logaddexp(0, lower @ b).sum()
                - (between * np.log(-np.expm1(-gap))).sum() + 0.5 * (penalty * b * b).sum())

    loss = loss_of(beta)
    for _ in range(rounds):
        u, v, gap = sigmoid(upper @ beta), sigmoid(lower @ beta), gaps @ beta
        pull = 1 / np.expm1(gap)
        grad = -upper.T @ (1 - u) + lower.T @ v - gaps.T @ (between * pull) + penalty * beta
        curve = (upper.T @ (upper * (u * (1 - u))[:, None]) + lower.T @ (lower * (v * (1 - v))[:, None])
                 + gaps.T @ (gaps * (between * pull * (1 + pull))[:, None]) + np.diag(penalty))
        move = np.linalg.solve(curve, grad)
        new, now = next(((n, l) for n, l in ((beta - move / 2 ** k, loss_of(beta - move / 2 ** k)) for k in range(30))
                         if l <= loss), (beta, loss))
        done = loss - now < 1e-8 * max(1.0, abs(loss))
        beta, loss = new, now
        if done:
            break
    return beta[:d], beta[d:]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fits the model. What comes to the driver is bounded: the counts of at most
    FEATURES words, and one row of feature counts for each of the sampled rows."""
    ship_package(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("y")).dropDuplicates(["id"])
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model()
    some = known.sampleBy("y", {k: min(1.0, rows / n) for k, n in sizes.items()}, SEED).limit(4 * rows)

    def counted(batches):
        for batch in batches:
            found = [feature_counts(t) for t in batch.column(1).to_pylist()]
            maps = pa.array([list(c.items()) for _, c in found], pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), maps],
                                             ["y", "n", "words"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = cut(texts.join(F.broadcast(some), "id").select(F.col("y").cast("int"), "text")
                 .mapInArrow(counted, "y int, n long, words map<string, long>"))
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model()
    shares = (sample.select("y", F.explode(F.map_keys("words")).alias("word")).groupBy("word")
              .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).where(F.col("t") + F.col("c") >= MIN_ROWS))
    odds = (F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1)))
    doubt = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = shares.select("word", odds.alias("odds"), (F.abs(odds) - 1.64 * doubt).alias("sure")).where("sure > 0.5").orderBy(
        F.col("sure").desc(), "word").limit(FEATURES).collect()
    typical = {r.word for r in best if r.odds > 0 and r.sure > 1}
    column = {r.word: k for k, r in enumerate(sorted(best, key=lambda r: r.word))}
    wanted = F.array(*[F.lit(w) for w in column]).cast("array<string>")
    kept = sample.select("y", "n", F.map_filter("words", lambda k, _: F.array_contains(wanted, k)).alias("words")).collect()
    x = np.zeros((len(kept), len(column) + 1))
    evidence = np.zeros(len(kept))
    y = np.array([r.y for r in kept])
    for k, r in enumerate(kept):
        x[k, -1] = length_feature(r.n or 0)
        for w, count in r.words.items():
            x[k, column[w]] = np.log1p(count)
            evidence[k] += np.log1p(count) * (w in typical)
    marked = evidence[(y == 1) & (evidence > 0)]
    edges = np.quantile(marked, np.arange(1, GRADES) / GRADES) if len(marked) else np.zeros(GRADES - 1)
    grade = np.where(y == 1, 1 + np.searchsorted(edges, evidence, "right"), 0)
    w, theta = fit_ordinal(x, np.minimum(grade, GRADES), GRADES)
    return Model(column, w, theta)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, severity (expected, 0 to GRADES),
    probability (of a grade above zero), toxic (probability of a half or more)."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            severity, above = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(severity, pa.float64()), pa.array(above, pa.float64()),
                 pa.array(above >= 0.5, pa.bool_())], ["doc_id", "severity", "probability", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, probability double, toxic boolean")
