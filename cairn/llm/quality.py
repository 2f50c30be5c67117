"""A quality classifier of naive Bayes support vectors.

Indicators of n-grams of words and of word shapes are scaled by their class log-count ratios, and a
linear hinge-loss model over them is fitted by dual coordinate descent; a logistic map of the margin,
fitted on margins of rows that a model hasn't seen, gives scores from 0 to 1.

The model is fitted on a bounded sample of labelled rows (``Settings.most_rows``); every text is
scored, whole. A null text is the empty one, whose score is that of the bias alone. With labels of
one class only, or none, every score is that class's (smoothed) rate. Only the text enters a score. Words of
more than 64 characters count as their character 4-grams.
"""

from __future__ import annotations

import hashlib
import operator
import pickle
import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import linear
from cairn.llm.frames import map_columns


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled sample, ``bits`` the hashed features, ``c`` is the hinge loss's weight."""

    most_rows: int = 4000
    bits: int = 18
    c: float = 0.05
    smoothing: float = 1.0
    folds: int = 3


MEMO_WORDS, SLICE_WORDS, LONG_TEXT = 200_000, 1 << 17, 1 << 22
_WORD = re.compile(r"\S+")


def shape(word: str) -> str:
    """Runs of upper and lower case, digits and other letters as one sign each; other characters as they are."""
    out = []
    for ch in word:
        kind = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if not out or out[-1] != kind or not kind.isalnum():
            out.append(kind)
        elif len(out) < 2 or out[-2] != kind:
            out.append(kind)  # one and many differ
    return "".join(out)


class Features:
    """The hashed n-grams of a whole text: words and word pairs, and shapes, pairs and triples of shapes, in
    which a word that repeats the one before has a shape of its own. Texts are worked through in slices, which
    changes nothing."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.memo = linear.TwoGenerations(lambda w: linear.stable_hash("s" + shape(w)) << 32 | linear.stable_hash("w" + w), MEMO_WORDS)
        self.repeat = np.uint64(linear.stable_hash("repeat"))

    def _mix(self, codes: np.ndarray, kind: int) -> np.ndarray:
        x = codes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & self.mask

    def __call__(self, text: str) -> np.ndarray:
        words = linear.pieces(text.split() if len(text) < LONG_TEXT else (m[0] for m in _WORD.finditer(text)))
        parts, before = [], []
        while some := list(islice(words, SLICE_WORDS)):
            parts.append(self._slice([*before, *some], len(before) == 3))
            before = [*before, *some][-3:]  # two that begin n-grams, and the one that the first of them may repeat
        if not parts:
            return np.empty(0, "i8")
        return (parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))).astype("i8")

    def _slice(self, words: list[str], inner: bool) -> np.ndarray:
        """The n-grams of the words; of an inner slice the first word is only what the next may repeat."""
        n = len(words)
        both = np.fromiter(map(self.memo.__getitem__, words), "u8", n)
        word, form = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
        if n > 1:
            form[1:][np.fromiter(map(operator.eq, words[1:], words), bool, n - 1)] = self.repeat
        if inner:
            word, form = word[1:], form[1:]
        wide, far = np.uint64(0x100000001B3), np.uint64(0xC2B2AE3D27D4EB4F)
        pairs = form[:-1] * wide + form[1:]
        grams = [self._mix(word, 1), self._mix(word[:-1] * wide + word[1:], 2), self._mix(form, 3), self._mix(pairs, 4), self._mix(pairs[:-1] * far + form[2:], 5)]
        return np.unique(np.concatenate(grams))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    a: float
    b: float
    bits: int

    def score(self, features: np.ndarray) -> float:
        return float(linear.sigmoid(np.array(self.a * (self.weights[features].sum(dtype="f8") + self.bias) + self.b)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> Model:  # noqa: B008
    """Fit on a bounded sample of ``labels`` (``doc_id``, ``label``) and the documents they name."""
    sample = linear.labelled_sample(docs.select("doc_id", "text"), labels, label, settings.most_rows)
    rows, y, _ = linear.collect_features(sample, lambda: Features(settings.bits), label)
    n = 1 << settings.bits
    if len(set(y.tolist())) < 2:
        rate = (float(y.sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(n, "f4"), 0.0, 1.0, float(np.log(rate / (1 - rate))), settings.bits)

    def ratios(own: linear.Rows, truth: np.ndarray) -> np.ndarray:
        p, q = (settings.smoothing + own.spread((truth == k).astype("f8"), n) for k in (1, 0))
        return np.log(p / p.sum()) - np.log(q / q.sum())

    def train(own: linear.Rows, truth: np.ndarray) -> tuple[np.ndarray, float]:
        r = ratios(own, truth)
        w, bias = linear.dual_coordinate_descent(own, r, truth, settings.c)
        return w * r, bias

    fold, margins = linear.folds(len(y), settings.folds), np.zeros(len(y))
    for k in range(settings.folds):
        seen, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(held) and len(set(y[seen].tolist())) == 2:
            w, bias = train(rows.pick(seen), y[seen])
            margins[held] = rows.pick(held).dot(w) + bias
    a, b = linear.platt(margins, y)
    w, bias = train(rows, y)
    return Model(w.astype("f4"), bias, a, b, settings.bits)


_features: dict[int, Features] = {}
_models: dict[str, Model] = {}


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add each text's score. The model is broadcast; its size is fixed by its feature bits."""
    packed = pickle.dumps(model)
    key, shared = hashlib.sha256(packed).hexdigest(), df.sparkSession.sparkContext.broadcast(packed)

    def kernel():
        if key not in _models:
            _models.clear()
            _models[key] = pickle.loads(shared.value)
        own = _models[key]
        features = _features.setdefault(own.bits, Features(own.bits))
        return lambda c: [pa.array([own.score(features(t.as_py() or "")) for t in c[0]], pa.float64())]

    return map_columns(df, [text_col], f"`{out_col}` double", kernel, keep)


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
