"""Operator 8: document quality by co-training a content view and a metadata view."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, list_column, stored, tuned
from .linear import Scaled, logistic, loss_sums, merged_moments, moments, newton, sigmoid

#: Labelled rows that the two views are fitted on, at most; of the unlabelled documents all take part.
MAX_LABELLED = 50_000
#: A view labels documents for the other beyond this logit (probability 0.95), by bins of logits.
SURE = math.log(19)
_EDGES = SURE + np.arange(4096) * 0.01
#: Documents below this calibrated probability of being good are rejected.
THRESHOLD = 0.1
#: Labelled rows that an average good rate counts for in the rate of a language or source.
RATE_PRIOR = 50.0
#: Folds of the labelled rows; a row's rates come from the other folds, the last fold calibrates.
FOLDS = 5
META = ("lang", "source", "n_chars")


def content_features(text: str | None) -> list[float]:
    """Figures of the text alone; a null or empty text has zeros but for the last."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * 15 + [1.0]
    chars = len(text)
    letters = [w for w in words if w.isalpha() or w[:-1].isalpha()]
    upper = sum(len(w) for w in words if w.isupper())
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    lines = text.split("\n")
    triple = sum(len(w) > 2 and w[-1] == w[-2] and not w[-1].isalnum() for w in words)
    lone = sum(not any(c.isalnum() for c in w) for w in words)
    stops = sum(len(w) <= 3 for w in words)
    ended = sum(w[-1] in ".,;:" for w in words)
    return [
        upper / chars, runs / n, len(counts) / n, top / n, triple / n, lone / n, stops / n, ended / n,
        sum(map(len, words)) / n / 10, len(letters) / n, len(set(lines)) / len(lines), min(1.0, n / len(lines) / 40),
        text.count("|") / chars * 10, sum(w.isdigit() for w in words) / n, math.log1p(n) / 10, 0.0,
    ]


def meta_features(text: str | None, n_chars) -> list[float]:
    """Figures of the page as an object: stated and stored size, their ratios, lines, how far it shrinks; null size has a slot of its own."""
    raw = (text or "").encode()
    size, stated = len(raw), 0.0 if n_chars is None else max(0.0, float(n_chars))
    spaces, lines = raw.count(b" "), raw.count(b"\n") + 1
    shrunk = len(zlib.compress(raw, 1)) if size else 0
    scale = math.log1p(stated or size) / 10
    return [
        scale, scale * scale, float(n_chars is None), float((stated or size) < 200), size / stated if stated else 1.0,
        min(4.0, size / (spaces + lines) / 10), math.log1p(size / lines) / 10, math.log1p(spaces / lines) / 10,
        min(1.0, shrunk / size) if size else 0.0, math.log1p(size / shrunk) if size else 0.0, float(not size),
    ]


N_CONTENT, N_META = len(content_features("")), len(meta_features("", None))


def views(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, content array<double>, meta array<double>, lang, source of every document; a missing metadata column is null."""
    tuned(docs.sparkSession)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text = batch.column(1).to_pylist()
                a, b = _figures(text, batch.column(4).to_pylist())
                cols = [list_column(x.ravel(), np.full(len(x), x.shape[1]), pa.float64()) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols, batch.column(2), batch.column(3)], ["id", "content", "meta", "lang", "source"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), *_meta_columns(docs))
    return src.mapInArrow(run, f"id {kind}, content array<double>, meta array<double>, lang string, source string")


def _meta_columns(docs: DataFrame) -> list[F.Column]:
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in zip(META, ("string", "string", "double"), strict=True)]


def _figures(text: list[str | None], n_chars: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([content_features(t) for t in text]), np.array([meta_features(t, n) for t, n in zip(text, n_chars, strict=True)])


class Rates:
    """Log-odds of being good by language and by source among labelled rows, shrunk to the average; unknown ones have the average."""

    def __init__(self, keys: tuple[list, list], y: np.ndarray):
        self.mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.tables = []
        for names in keys:
            n, good = Counter(names), Counter(k for k, v in zip(names, y.tolist(), strict=True) if v)
            self.tables.append({k: self._logit((good[k] + RATE_PRIOR * self.mean) / (n[k] + RATE_PRIOR)) for k in n})

    @staticmethod
    def _logit(p: float) -> float:
        return math.log(p / (1 - p))

    def __call__(self, keys: tuple[list, list]) -> np.ndarray:
        return np.array([[t.get(k, self._logit(self.mean)) for k in names] for t, names in zip(self.tables, keys, strict=True)]).T.reshape(-1, 2)


def _replayed(a: np.ndarray, b: np.ndarray, history: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are still free after the rounds of history, and the labels given to each view (nan: none)."""
    free = np.ones(len(a), bool)
    marks = np.full(len(a), np.nan), np.full(len(a), np.nan)
    for wa, ta, wb, tb in history:
        za, zb = a @ wa, b @ wb
        by_a, by_b = free & (np.abs(za) >= ta), free & (np.abs(zb) >= tb)
        marks[1][by_a] = za[by_a] > 0
        marks[0][by_b] = zb[by_b] > 0
        free &= ~(by_a | by_b)
    return free, *marks


def _threshold(counts: np.ndarray, quota: int) -> float:
    """The least edge beyond which at most quota rows lie (those of one bin at least); infinite without rows."""
    beyond = counts[::-1].cumsum()[::-1]
    if not beyond[0]:
        return math.inf
    fits = np.flatnonzero((beyond > 0) & (beyond <= quota))
    return float(_EDGES[fits[0] if len(fits) else np.flatnonzero(beyond)[-1]])


class Pool:
    """Stored views of documents, in passes that reduce each task's rows to one array of sums."""

    def __init__(self, view: DataFrame, rates: Rates | None = None):
        self.view, self.rates = view, rates

    def over(self, f: Callable[[np.ndarray, np.ndarray], np.ndarray], merge=np.add, known: bool = False) -> np.ndarray | None:
        """f of the unlabelled rows (with known, of all rows) of each batch, merged; None without rows."""

        rates = self.rates

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    one = f(*_matrices(batch, rates))
                    total = one if total is None else merge(total, one)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        src = self.view if known else self.view.where("not known")
        total = None
        for r in src.select("content", "meta", "lang", "source").mapInArrow(run, "sums binary").collect():
            one = np.frombuffer(r.sums)
            total = one if total is None else merge(total, one)
        return total


def _matrices(rows: pa.RecordBatch | pa.Table, rates: Rates) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for name, width in (("content", N_CONTENT), ("meta", N_META)):
        column = rows.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        out.append(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
    return out[0], np.hstack([out[1], rates(_keys(rows))])


def _keys(rows: pa.RecordBatch | pa.Table) -> tuple[list, list]:
    return rows.column("lang").to_pylist(), rows.column("source").to_pylist()


class CoTrained:
    """Two classifiers that taught each other, their calibrations and the combination.

    fold tells the labelled rows apart: the last one is held back for the calibration.
    exchanged has, for each round, how many labels content gave and how many metadata gave.
    """

    def __init__(self, xa: np.ndarray, xb: np.ndarray, y: np.ndarray, fold: np.ndarray, pool: Pool, rounds: int = 5, per_round: float = 0.1):
        self.rates, self.labelled, self.labelled_y, self.labelled_fold = pool.rates, (xa, xb), y, fold
        both = len(set(y.tolist())) == 2
        self.prior = float(y.mean()) if len(y) else 1.0
        self.fitted = both and len(y) >= 20
        if not self.fitted:
            return
        n, *rest = np.split(pool.over(lambda a, b: moments(np.hstack([a, b])), merged_moments, known=True), [1, 1 + xa.shape[1] + xb.shape[1]])
        (ma, mb), (va, vb) = (np.split(x, [xa.shape[1]]) for x in rest)
        self.sa, self.sb = sa, sb = Scaled(mean=ma, sd=np.sqrt(va / n)), Scaled(mean=mb, sd=np.sqrt(vb / n))
        fold = fold == FOLDS - 1
        la, lb, t = sa(xa[~fold]), sb(xb[~fold]), y[~fold].astype(float)
        history: list[tuple] = []  # both models of a round and the logits from which they labelled
        self.pool_rows, self.exchanged = 0, []
        w = [np.zeros(la.shape[1]), np.zeros(lb.shape[1])]
        cut = 2 + la.shape[1] + la.shape[1] ** 2
        for r in range(rounds + 1):

            def sums(trial: list[np.ndarray], history=tuple(history)) -> list[np.ndarray]:
                def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                    a, b = sa(a), sb(b)
                    _, for_a, for_b = _replayed(a, b, history)
                    return np.concatenate([loss_sums(x[m >= 0], m[m >= 0], v) for x, m, v in ((a, for_a, trial[0]), (b, for_b, trial[1]))])

                own = [loss_sums(la, t, trial[0]), loss_sums(lb, t, trial[1])]
                if history and (more := pool.over(of)) is not None:
                    own = [x + z for x, z in zip(own, np.split(more, [cut]), strict=True)]
                return own

            w = newton(sums, w)
            if r == rounds:
                break

            def confident(a: np.ndarray, b: np.ndarray, history=tuple(history), w=tuple(w)) -> np.ndarray:
                a, b = sa(a), sb(b)
                free = _replayed(a, b, history)[0]
                bins = [np.minimum(((np.abs(x[free] @ v) - SURE) / 0.01 // 1).astype(int), len(_EDGES) - 1) for x, v in ((a, w[0]), (b, w[1]))]
                return np.concatenate([[len(a)], *(np.bincount(i[i >= 0], minlength=len(_EDGES)) for i in bins)]).astype(float)

            counts = pool.over(confident)
            if counts is None:
                break
            self.pool_rows = int(counts[0])
            by_a, by_b = np.split(counts[1:], 2)
            edges = [_threshold(c, int(per_round * self.pool_rows)) for c in (by_a, by_b)]
            if min(edges) == math.inf:
                break  # neither view is sure of anything
            self.exchanged.append(tuple(int(c[_EDGES >= e].sum()) for c, e in zip((by_a, by_b), edges, strict=True)))
            history.append((w[0], edges[0], w[1], edges[1]))
        self.wa, self.wb = w
        held = np.stack([self.sa(xa[fold]) @ self.wa, self.sb(xb[fold]) @ self.wb], 1)
        self.ca, self.cb = (logistic(np.stack([np.ones(len(held)), held[:, i]], 1), y[fold].astype(float), ridge=1e-4) for i in (0, 1))
        self.combine = logistic(self._calibrated(held), y[fold].astype(float), ridge=1e-3)

    def __getstate__(self) -> dict:
        """Tasks score with the fitted parts; the labelled rows stay on the driver."""
        return {k: v for k, v in self.__dict__.items() if not k.startswith("labelled")}

    def _calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(raw)), np.clip(self.ca[0] + self.ca[1] * raw[:, 0], -12, 12), np.clip(self.cb[0] + self.cb[1] * raw[:, 1], -12, 12)], 1)

    def scores(self, xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
        """Columns: combined, content and metadata probability of being good."""
        if not self.fitted:
            return np.full((len(xa), 3), self.prior)
        c = self._calibrated(np.stack([self.sa(xa) @ self.wa, self.sb(xb) @ self.wb], 1))
        return np.stack([sigmoid(c @ self.combine), sigmoid(c[:, 1]), sigmoid(c[:, 2])], 1)


def _sample(labels: DataFrame, label_col: str, max_labelled: int) -> DataFrame:
    """id, y of the labels of the smallest hashes."""
    return labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").orderBy(F.xxhash64("id", F.lit(8)), "y").limit(max_labelled)


def prepared(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The stored views with known: whether a row has one of the labels that are fitted on."""
    ids = _sample(labels, label_col, max_labelled).select("id").distinct().withColumn("known", F.lit(True))
    return stored(views(docs).join(F.broadcast(ids), "id", "left").select("id", "content", "meta", "lang", "source", F.coalesce("known", F.lit(False)).alias("known")), "quality")


def fit(view: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> CoTrained:
    """Fits prepared views on at most max_labelled labelled rows, those of the smallest hashes, and on all others.

    The two views exchange labels over all rows without a label, and features are scaled
    by the figures of all rows: each step is a pass of Spark that returns sums. The
    labelled rows come to the driver: some 300 bytes each, 15 MB at the bound.
    """
    lab = _sample(labels, label_col, max_labelled)
    known = view.where("known").join(F.broadcast(lab), "id").select("content", "meta", "lang", "source", "y").orderBy(F.xxhash64("id", F.lit(9)), "y").limit(max_labelled).toArrow()
    y, keys = known.column("y").to_numpy(), _keys(known)
    fold = np.arange(len(y)) % FOLDS
    rates = Rates(keys, y)
    xa, xb = _matrices(known, rates)
    for k in range(FOLDS):  # a labelled row's rates don't know its own label
        own = fold == k
        other = tuple([v for v, o in zip(names, own, strict=True) if not o] for names in keys)
        xb[own, N_META:] = Rates(other, y[~own])(tuple([v for v, o in zip(names, own, strict=True) if o] for names in keys))
    return CoTrained(xa, xb, y, fold, Pool(view, rates))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, score, content_score, meta_score (doubles, 1 is good), kept boolean.

    Null and empty texts are scored by their own feature, long ones whole; null metadata
    has slots of its own or the average rate, missing metadata columns count as null,
    others are left out whatever their names. Without labels of both classes every score
    is the share of good labels (1 without any); an empty table gives no rows. Of several
    labels of one id all count; equal rows have equal scores. Repeated rows and null ids
    stay. Texts are read once; their few figures go to the shared folder and models and
    scores come from there.
    """
    view = prepared(docs, labels, label_col)
    model = fit(view, labels, label_col)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.scores(*_matrices(b, model.rates))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[:, i]) for i in range(3)), pa.array(s[:, 0] >= threshold)], ["doc_id", "score", "content_score", "meta_score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return view.drop("known").mapInArrow(run, f"doc_id {kind}, score double, content_score double, meta_score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns.

    As score(): null and empty texts are judged too, repeated rows alike, ids may be null
    or repeated, extra columns of any name stay; an empty table stays empty.
    """
    model = fit(prepared(docs, labels), labels)

    @F.pandas_udf("double")
    def good(text, lang, source, size):
        import pandas as pd

        if not len(text):
            return pd.Series([], dtype=float)
        a, b = _figures(text.tolist(), [None if pd.isna(n) else n for n in size])
        keys = tuple([None if pd.isna(k) else k for k in names] for names in (lang, source))
        return pd.Series(model.scores(a, np.hstack([b, model.rates(keys)]))[:, 0])

    return docs.where(good(F.col("text").cast("string"), *_meta_columns(docs)) >= threshold)
