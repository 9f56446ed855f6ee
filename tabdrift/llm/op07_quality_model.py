"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is binned; cyclic boosting visits the features in turn and adds a small step of a shallow tree
over the bins, so that each feature ends with a lookup table. The strongest pairs then get tables over two features in
the same way. Scoring is one addition of looked-up numbers per table, vectorised over rows.

Features are taken from whole texts. The model is fitted on the driver on at most FIT_ROWS labelled rows, those with
the smallest hash of their id, which is the same choice wherever it is made; everything else runs over all rows.

Cases: a null text counts as empty, and an empty text gets the score of its features (all zero); labels with a null id
or label are left out; a document without an id isn't held out; repeated rows each get a row; without labels of both
kinds every score is the share of label 1 (0.5 without any); an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, utf8

#: Most labelled rows that the model is fitted on.
FIT_ROWS = 20_000
FEATURES = (
    "log_words", "word_length", "distinct", "top_word", "upper", "digit", "symbol", "exclamation", "pipe", "comma",
    "stop", "non_ascii", "line_words", "dup_lines", "dup_pairs", "long_words",
)
_SYMBOL = np.frombuffer(b"#*$%&|<>", np.uint8)


def features(text: str | None) -> list[float]:
    data = utf8(text)
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    ink = int(lengths.sum())
    return [
        float(np.log1p(n)), ink / n, len(seen) / n, max(seen.values()) / n, byte[65:91].sum() / ink, byte[48:58].sum() / ink,
        byte[_SYMBOL].sum() / n, byte[33] / n, byte[124] / n, byte[44] / n, byte[46] / n, byte[128:].sum() / size, n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), 1 - len(pairs) / max(1, n - 1), float((lengths > 14).mean()),
    ]


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): one row of features per document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """base + one table for each feature + one for each pair; edges cut features into bins."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]):
        self.base, self.edges, self.tables, self.pairs = base, edges, tables, pairs

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[j]]
        for i, j, t in self.pairs:
            out += t[b[i] >> 2, b[j] >> 2]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _leaf(g, h, ridge: float = 1.0):
    return g / (h + ridge)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best single cut through bins in order (0: none)."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    left = cg[:-1] * _leaf(cg[:-1], ch[:-1])
    right = (cg[-1] - cg[:-1]) * _leaf(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
    if not len(left):
        return 0.0, 0
    gain = left + right - cg[-1] * _leaf(cg[-1], ch[-1])
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, cuts: int = 2) -> np.ndarray:
    """Leaf value of each bin under a tree of a few cuts."""
    bounds = [0, len(g)]
    for _ in range(cuts):
        options = [(*_cut(g[a:b], h[a:b]), a) for a, b in zip(bounds, bounds[1:])]
        gain, k, a = max(options)
        if gain <= 1e-9 or not k:
            break
        bounds = sorted([*bounds, a + k])
    out = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The same over two features: one cut along the first, one in each part along the second."""
    _, k = _cut(g.sum(1), h.sum(1))
    out, gain = np.zeros(g.shape), -g.sum() * _leaf(g.sum(), h.sum())
    for part in (slice(0, k), slice(k, None)):
        if g[part].size == 0:
            continue
        _, m = _cut(g[part].sum(0), h[part].sum(0))
        for side in (slice(0, m), slice(m, None)):
            sg, sh = g[part, side].sum(), h[part, side].sum()
            out[part, side] = _leaf(sg, sh)
            gain += sg * _leaf(sg, sh)
    return gain, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.15, bins: int = 32) -> Model:
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Model(base, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(base, edges, tables, [])
    b = model.bins(x)
    f = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[j], g, len(t)), np.bincount(b[j], h, len(t)))
            t += step
            f += step[b[j]]
    coarse = [c >> 2 for c in b]
    width = [(len(t) - 1 >> 2) + 1 for t in tables]
    grid = lambda i, j, v: np.bincount(coarse[i] * width[j] + coarse[j], v, width[i] * width[j]).reshape(width[i], width[j])
    g, h = slopes()
    ranked = sorted(((_tree2(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(tables)) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for _, i, j in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = rate * _tree2(grid(i, j, g), grid(i, j, h))[1]
            t += step
            f += step[coarse[i], coarse[j]]
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> Model:
    """Fits on labelled rows outside the held-out fold; rows is extract()'s."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").distinct()
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    sample = known.join(rows, "doc_id").orderBy("doc_id", "y", "x").limit(most).collect()
    x = np.array([r["x"] for r in sample], np.float64).reshape(len(sample), len(FEATURES))
    return fit(x, np.array([r["y"] for r in sample], np.float64))


def apply(spark, rows: DataFrame, model: Model) -> DataFrame:
    held = spark.sparkContext.broadcast(model)  # a few tables of 32 numbers

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            score = held.value.score(flat.reshape(batch.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    rows = Scratch(spark).save(extract(spark.read.parquet(f"{sf_dir}/documents.parquet")), "features")
    model = train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply(spark, rows, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
