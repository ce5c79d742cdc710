"""A quality classifier: histogram gradient-boosted trees over statistics of a document's text.

The statistics need one pass over a text. Training takes at most `sample` labelled documents (those of least hash), bins
each statistic at its quantiles and grows complete trees of fixed depth from histograms of gradients on the driver.
The trees are flat arrays; scoring follows all rows of a batch through a tree at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = (
    "log_bytes", "upper", "digit", "space", "newline", "non_ascii", "bar", "shout", "symbol", "stop", "other_punct", "log_words", "word_length",
    "distinct_words", "top_word", "one_letter", "wordless", "log_lines", "distinct_lines", "line_bytes", "distinct_pairs", "longest_word", "shouted_words",
)

_CLASSES = 11
_CLASS_OF = np.zeros(256, dtype=np.uint8)
for _byte in range(256):
    _c = chr(_byte)
    _CLASS_OF[_byte] = (
        1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _c in " \t\r\f\v" else 4 if _c == "\n" else 5 if _byte >= 128
        else 6 if _c == "|" else 7 if _c == "!" else 8 if _c in "$%&#*@~^<>={}[]\\" else 9 if _c in ".,;:?" else 10 if not _c.isalnum() else 0
    )


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of NAMES; zeros for a null or empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(NAMES)
    n = len(data)
    share = (np.bincount(_CLASS_OF[np.frombuffer(data, dtype=np.uint8)], minlength=_CLASSES) / n).tolist()
    words, lines = data.split(), data.split(b"\n")
    k = max(1, len(words))
    counts = Counter(words)
    full = [x for x in lines if x]
    return [
        float(np.log1p(n)), *share[1:], float(np.log1p(len(words))), sum(map(len, words)) / k, len(counts) / k, max(counts.values(), default=0) / k,
        sum(c for w, c in counts.items() if len(w) == 1) / k, sum(c for w, c in counts.items() if w.upper() == w.lower()) / k,
        float(np.log1p(len(lines))), len(set(full)) / max(1, len(full)), n / len(lines), len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1),
        float(max(map(len, words), default=0)), sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / k,
    ]


class Trees:
    """Complete binary trees in flat arrays: node i has children 2i+1 and 2i+2; a row goes right where its value is above the cut."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature, self.cut, self.leaf = np.zeros((0, 2**depth - 1), dtype=np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth))

    def add(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> None:
        self.feature, self.cut, self.leaf = np.vstack([self.feature, feature]), np.vstack([self.cut, cut]), np.vstack([self.leaf, leaf])

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row."""
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boosts trees on log loss. Without rows, scores are 1/2; with one label only, they stay near it."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))), depth)
    if len(y) < 2 or y.min() == y.max():
        return model
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # bin b: cuts[b-1] < value <= cuts[b]
    total = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, size = 2**level - 1, 2**level
            at = node - first
            gain, best_f, best_b = np.full(size, 1e-9), np.zeros(size, dtype=np.int64), np.full(size, -1)
            for f in range(width):
                key = at * bins + binned[:, f]
                gl = np.cumsum(np.bincount(key, g, size * bins).reshape(size, bins), axis=1)
                hl = np.cumsum(np.bincount(key, h, size * bins).reshape(size, bins), axis=1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                better = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                better[(hl < least) | (ha - hl < least)] = 0
                better[:, len(cuts[f]) :] = 0
                b = better.argmax(axis=1)
                new = better[np.arange(size), b] > gain
                gain[new], best_f[new], best_b[new] = better[np.arange(size), b][new], f, b[new]
            for i in np.flatnonzero(best_b >= 0):
                feature[first + i], cut[first + i] = best_f[i], cuts[best_f[i]][best_b[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        model.add(feature, cut, leaf)
        total += leaf[at]
    return model


def _features(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "x": [statistics(t) for t in batch["text"]]})


def held_out(id_col: str = "doc_id"):
    """True for the fifth of all ids that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = 20_000, **parameters) -> Trees:
    """Trees fitted to labelled documents that are not held out, at most `sample` of them, those of least hash.

    A document with several labels has their majority, ties counting as 1; null labels and ids are left out. Of several
    texts of one id the one with the least statistics counts.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    chosen = usable.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    found = texts.mapInPandas(_features, "id long, label int, x array<double>").groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas().sort_values("id")
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(len(found), len(NAMES))
    return fit(x, found["label"].to_numpy(dtype=np.float64), **parameters)


def scorer(model: Trees):
    """A column function: the score of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for a in range(0, len(texts), 512):
            part = texts.iloc[a : a + 512]
            out[a : a + len(part)] = model.score(np.array([statistics(t) for t in part]).reshape(len(part), len(NAMES)))
        return pd.Series(out)

    return score


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.3, **parameters) -> DataFrame:
    """docs with score, predicted (1 from `threshold` on) and held_out; all rows and other columns stay.

    Null and empty texts are scored by statistics of zero. A null id is not held out. Without labels all scores are 1/2.
    Columns of docs named as these three are replaced.
    """
    model = train(docs, labels, id_col, text_col, **parameters)
    out = docs.withColumn("score", scorer(model)(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", held_out(id_col))
