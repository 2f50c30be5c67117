"""Linear models over sparse indicators, fitted on the driver from a bounded sample."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.frames import map_columns


#: Longer words (runs without white space, as in scripts that don't use it) count as their overlapping character n-grams.
LONGEST_WORD, LONG_GRAM = 64, 4


def pieces(words: Iterable[str]) -> Iterator[str]:
    """The words, each longer one as its character n-grams; so what a memo holds of them is bounded."""
    for word in words:
        if len(word) <= LONGEST_WORD:
            yield word
        else:
            for i in range(len(word) - LONG_GRAM + 1):
                yield word[i : i + LONG_GRAM]


def stable_hash(text: str) -> int:
    """32 bits that don't depend on the process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")


class Rows:
    """Sparse 0/1 rows: row i has the features ``of[at[i]:at[i+1]]``."""

    def __init__(self, features: Iterable[np.ndarray]):
        own = list(features)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in own], dtype="i8")]).astype("i8")
        self.of = np.concatenate([np.empty(0, "i8"), *own]).astype("i8")

    def __len__(self) -> int:
        return len(self.at) - 1

    def row(self, i: int) -> np.ndarray:
        return self.of[self.at[i] : self.at[i + 1]]

    def pick(self, which: np.ndarray) -> Rows:
        return Rows(self.row(i) for i in which.tolist())

    def only(self, keep: np.ndarray) -> Rows:
        """The rows with features renumbered by ``keep`` (-1: left out)."""
        return Rows((y := keep[self.row(i)])[y >= 0] for i in range(len(self)))

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.of])])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def spread(self, v: np.ndarray, n: int) -> np.ndarray:
        """The sum of v over the rows that have each feature."""
        return np.bincount(self.of, np.repeat(v, np.diff(self.at)), n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(rows: Rows, dense: np.ndarray, y: np.ndarray, n: int, l2: float = 0.1, steps: int = 600) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the n features and of the dense columns, and the bias, by diagonally scaled gradient steps."""
    w, d, rate = np.zeros(n), np.zeros(dense.shape[1]), float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    b = float(np.log(rate / (1 - rate)))
    sw, sd, sb = np.full(n, 1e-8), np.full(dense.shape[1], 1e-8), 1e-8
    for _ in range(steps):
        error = sigmoid(rows.dot(w) + dense @ d + b) - y
        gw, gd, gb = rows.spread(error, n) + l2 * w, dense.T @ error + l2 * d, error.sum()
        sw, sd, sb = sw + gw * gw, sd + gd * gd, sb + gb * gb
        w, d, b = w - 0.5 * gw / np.sqrt(sw), d - 0.5 * gd / np.sqrt(sd), b - 0.1 * gb / np.sqrt(sb)
    return w, d, float(b)


def dual_coordinate_descent(rows: Rows, scale: np.ndarray, y: np.ndarray, c: float, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Hinge-loss weights over ``scale`` times the indicators, with the bias as a feature of value 1.

    Each step minimises the dual in one row's multiplier and adds the change to the weights.
    """
    sign, w, bias = np.where(y > 0, 1.0, -1.0), np.zeros(len(scale)), 0.0
    alpha, norms = np.zeros(len(rows)), rows.dot(scale * scale) + 1
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)).tolist():
            own = rows.row(i)
            x = scale[own]
            slope = sign[i] * (w[own] @ x + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), c)
            if (step := (new - alpha[i]) * sign[i]) != 0:
                w[own] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * c:
            break
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(a, b) of the probability sigmoid(a * margin + b), fitted by Newton steps with smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margins + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = float(g @ margins) + 1e-3 * (a - 1), float(g.sum())
        haa, hab, hbb = float(h @ margins**2) + 1e-3, float(h @ margins), float(h.sum()) + 1e-9
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(1e-3, a - float(np.clip(da, -1, 1))), b - float(np.clip(db, -5, 5))
        if abs(da) + abs(db) < 1e-7:
            break
    return a, b


def folds(n: int, k: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).permutation(n) % k


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled documents, the first in the order of a hash of their ids.

    The chosen labels are at most ``most`` narrow rows, so they can be broadcast: texts aren't shuffled.
    """
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, label)
    chosen = chosen.orderBy(F.xxhash64(F.lit("sample"), F.col(id_col)), id_col, label).limit(most)
    return docs.join(F.broadcast(chosen), id_col)


def collect_features(sample: DataFrame, make: Callable[[], Callable[[str], np.ndarray]], label: str, extra: Callable[[str], list[int]] | None = None) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Each sampled text's features (and ``extra`` facts), made on the executors. Rows of one id and label count
    once (of different texts the one whose features hash highest), so what is collected is bounded as the sample is."""

    def kernel():
        features = make()

        def run(columns):
            texts = [t.as_py() or "" for t in columns[0]]
            return [pa.array([np.sort(features(t)).astype("<i4").tobytes() for t in texts], pa.binary()), pa.array([extra(t) if extra else [] for t in texts], pa.list_(pa.int32()))]

        return run

    made = map_columns(sample, ["text"], "features binary, facts array<int>", kernel, [label, "doc_id"])
    once = made.groupBy("doc_id", label).agg(F.max(F.struct(F.xxhash64("features").alias("h"), "features", "facts")).alias("x"))
    rows = sorted(once.select("doc_id", label, "x.features", "x.facts").collect(), key=lambda r: (r["doc_id"], r[label]))
    found = Rows(np.frombuffer(r["features"], "<i4") for r in rows)
    return found, np.array([r[label] for r in rows], "i8"), np.array([r["facts"] for r in rows], "i8").reshape(len(rows), -1 if rows else 0)


class TwoGenerations(dict):
    """A bounded memo: what isn't asked for while the younger half fills goes."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self._make, self._half, self._older = make, most // 2, {}

    def __missing__(self, key):
        value = self._older.pop(key, None)
        if value is None:
            value = self._make(key)
        if len(self) >= self._half:
            self._older = dict(self)
            self.clear()
        self[key] = value
        return value
