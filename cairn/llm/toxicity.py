"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over word and word-stem indicators; each
later model also sees the probabilities of the earlier categories. While training, those are
out-of-fold: they come from models, and features chosen, that haven't seen the row. So do the probabilities
that the threshold of the verdict is set from.

The labels have one category only. The two before it are weak labels: a toxic text that has one of a few seed words
(`SEEDS`). More than that about categories can't be had from these tables.

The models are fitted on a bounded sample of labelled rows (``Settings.most_rows``), every text is
judged, whole. A null text is the empty one, judged by the biases alone. With labels of one class only,
or none, nothing can be told apart: every probability is 0.01, and no text is rejected. Repeated rows get
equal results.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm import linear
from cairn.llm.frames import map_columns

WORD = re.compile(r"[^\W\d_]+")
#: Categories before the labelled one: a toxic text has one if it has such a word.
SEEDS = {
    "insult": ("idiot", "moron", "loser", "clown", "stupid"),
    "contempt": ("worthless", "pathetic", "disgusting", "scum", "trash"),
}
LABEL = "toxic"
CHAIN = (*SEEDS, LABEL)


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled sample; ``stems`` are the lengths of word beginnings that count as
    indicators; features are chosen by how unevenly the labels have them, ``most_features`` of those in at least
    ``least_docs`` rows and ``least_share`` of all. ``threshold`` is where a text counts as toxic; None: where
    the rows' out-of-fold probabilities tell the labels apart best, a share of clean rows above it weighing
    ``clean_weight`` times as much as that of toxic rows below it (see `parted`)."""

    most_rows: int = 6000
    bits: int = 22
    stems: tuple[int, ...] = (4, 5, 6)
    least_docs: int = 3
    least_share: float = 0.003
    most_features: int = 400
    folds: int = 3
    l2: float = 0.1
    threshold: float | None = None
    clean_weight: float = 7.0


MEMO_WORDS = 200_000


def words_of(text: str) -> set[str]:
    return set(linear.pieces(m[0] for m in WORD.finditer(text.lower())))


class Words:
    """The hashed words and word stems of a text."""

    def __init__(self, settings: Settings):
        mask, stems = (1 << settings.bits) - 1, settings.stems

        def hashed(word: str) -> tuple[int, ...]:
            return tuple({linear.stable_hash("w" + word) & mask, *(linear.stable_hash(f"{n}{word[:n]}") & mask for n in stems if len(word) >= n)})

        self.memo = linear.TwoGenerations(hashed, MEMO_WORDS)

    def __call__(self, text: str) -> np.ndarray:
        found: set[int] = set()
        found.update(*map(self.memo.__getitem__, words_of(text)))
        return np.fromiter(found, "i8", len(found))


@dataclass
class Model:
    features: np.ndarray  # hashed, sorted
    weights: np.ndarray  # a row a category
    dense: list[np.ndarray]  # a category's weights of the earlier ones' probabilities
    bias: list[float]
    settings: Settings
    threshold: float = 0.5

    def chain(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities from each category's sum of weights, in order."""
        out: list[float] = []
        for k, b in enumerate(self.bias):
            out.append(float(linear.sigmoid(np.array(sums[k] + b + sum(x * y for x, y in zip(self.dense[k], out, strict=True))))))
        return np.array(out)


def facts(text: str) -> list[int]:
    words = set(WORD.findall(text.lower()))
    return [int(not words.isdisjoint(own)) for own in SEEDS.values()]


def _chosen(rows: linear.Rows, y: np.ndarray, settings: Settings) -> np.ndarray:
    """Features by the size of their smoothed log-odds between the classes times the root of their count."""
    n = int(rows.of.max(initial=-1)) + 1
    pos, neg = rows.spread((y == 1).astype("f8"), n), rows.spread((y == 0).astype("f8"), n)
    rate_pos, rate_neg = (pos + 0.5) / ((y == 1).sum() + 1), (neg + 0.5) / ((y == 0).sum() + 1)
    weight = np.where(pos + neg >= max(settings.least_docs, settings.least_share * len(rows)), np.abs(np.log(rate_pos / rate_neg)) * np.sqrt(pos + neg), 0)
    top = np.argsort(-weight, kind="stable")[: settings.most_features]
    return np.sort(top[weight[top] > 0])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Fit the chain on a bounded sample of ``labels`` (``doc_id``, ``toxic``) and the documents they name."""
    sample = linear.labelled_sample(docs.select("doc_id", "text"), labels, LABEL, settings.most_rows)
    rows, toxic, seeds = linear.collect_features(sample, lambda: Words(settings), LABEL, facts)
    targets = [*(seeds[:, k] * toxic for k in range(len(SEEDS)) if len(toxic)), toxic]
    n_steps = len(CHAIN)
    if len(set(toxic.tolist())) < 2:
        return Model(np.empty(0, "i8"), np.zeros((n_steps, 0)), [np.zeros(k) for k in range(n_steps)], [float(np.log(0.01 / 0.99))] * n_steps, settings)
    # features are numbered by what occurs: tables are as long as that, not as all hashes
    known, rows.of = np.unique(rows.of, return_inverse=True)
    every, features, own, n = rows, *_reduced(rows, toxic, np.arange(len(toxic)), settings)
    features = known[features]
    fold = linear.folds(len(toxic), settings.folds)
    parts = []
    for f in range(settings.folds):
        seen = np.flatnonzero(fold != f)
        parts.append((seen, np.flatnonzero(fold == f), *_reduced(every, toxic, seen, settings)[1:]))
    earlier, weights, dense, bias = np.zeros((len(toxic), 0)), [], [], []
    for y in targets:
        unseen = np.zeros(len(y))
        for seen, held, reduced, n_own in parts:
            w, d, b = linear.logistic(reduced.pick(seen), earlier[seen], y[seen], n_own, settings.l2)
            unseen[held] = linear.sigmoid(reduced.pick(held).dot(w) + earlier[held] @ d + b)
        w, d, b = linear.logistic(own, earlier, y, n, settings.l2)
        weights.append(w)
        dense.append(d)
        bias.append(b)
        earlier = np.column_stack([earlier, unseen])
    threshold = parted(earlier[:, -1], toxic, settings.clean_weight) if settings.threshold is None else settings.threshold
    return Model(features, np.array(weights), dense, bias, settings, threshold)


def _reduced(rows: linear.Rows, y: np.ndarray, seen: np.ndarray, settings: Settings) -> tuple[np.ndarray, linear.Rows, int]:
    """The features that the seen rows choose, all rows with those only, and how many there are."""
    features = _chosen(rows.pick(seen), y[seen], settings)
    number = np.full(int(rows.of.max(initial=-1)) + 1, -1, "i8")
    number[features] = np.arange(len(features))
    return features, rows.only(number), len(features)


def parted(p: np.ndarray, y: np.ndarray, clean_weight: float = 1.0) -> float:
    """The threshold with the largest difference between the share of toxic rows above it and the weighted share of
    clean ones, in the middle (by log-odds) of the gap that it lies in; at least 0.05, so that no score near none
    rejects a text."""
    order = np.argsort(-p, kind="stable")
    ranked, hit = p[order], y[order] == 1
    gain = np.cumsum(hit) / max(1, hit.sum()) - clean_weight * np.cumsum(~hit) / max(1, (~hit).sum())
    gain[:-1][ranked[:-1] == ranked[1:]] = -np.inf
    at = int(np.argmax(gain))
    odds = lambda x: float(np.log(np.clip(x, 1e-6, 1 - 1e-6) / (1 - np.clip(x, 1e-6, 1 - 1e-6))))
    low = ranked[at + 1] if at + 1 < len(ranked) else 0.0
    return max(0.05, float(linear.sigmoid(np.array((odds(ranked[at]) + odds(low)) / 2))))


class _Judge:
    def __init__(self, model: Model):
        self.model, at = model, {f: i for i, f in enumerate(model.features.tolist())}
        hashed = Words(model.settings).memo._make
        self.memo = linear.TwoGenerations(lambda w: tuple(at[h] for h in hashed(w) if h in at), MEMO_WORDS)

    def __call__(self, text: str) -> np.ndarray:
        found: set[int] = set()
        found.update(*map(self.memo.__getitem__, words_of(text)))
        return self.model.chain(self.model.weights[:, sorted(found)].sum(1))


_judges: dict[str, _Judge] = {}


def judge(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, prefix: str = "p_", verdict: str = "is_toxic") -> DataFrame:
    """Add ``p_<category>`` for each category of the chain, and ``is_toxic`` (0 or 1)."""
    packed = pickle.dumps(model)
    key, shared = hashlib.sha256(packed).hexdigest(), df.sparkSession.sparkContext.broadcast(packed)
    threshold = model.threshold

    def kernel():
        if key not in _judges:
            _judges.clear()
            _judges[key] = _Judge(pickle.loads(shared.value))
        own = _judges[key]

        def run(columns):
            p = np.array([own(t.as_py() or "") for t in columns[0]]).reshape(-1, len(CHAIN))
            return [*(pa.array(p[:, k]) for k in range(len(CHAIN))), pa.array((p[:, -1] >= threshold).astype("i4"))]

        return run

    spec = ", ".join([*(f"`{prefix}{c}` double" for c in CHAIN), f"`{verdict}` int"])
    return map_columns(df, [text_col], spec, kernel, keep)
