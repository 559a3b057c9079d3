"""Operator 10: toxicity by weak supervision.

Lexicon and pattern voters vote on every document. A generative label model, fitted by
expectation-maximisation on the counts of all vote patterns, estimates each voter's
accuracy and how voters depend on one another (a tree, found anew in each round), and a
linear classifier is trained on the posterior labels of all documents. Given labels
never vote: they are what lexicons are mined from, and they anchor the label model's
tables through votes of lexicons that were mined without the row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, list_column, stored, texts, tuned
from .linear import Scaled, loss_sums, merged_moments, moments, newton, sigmoid

#: Labelled rows that lexicons are mined from and the label model is anchored by, at most; all other fitting covers all rows.
MAX_LABELLED = 50_000
#: Parts of the labelled rows; each is voted on by lexicons of the others. Weight of all labelled rows against all others.
FOLDS, ANCHOR = 5, 3.0
#: Toxic rows that a lexicon entry stands in, and its log-odds, at least.
LEAST_ROWS, LEAST_ODDS = 3, 4.0
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "garbage", "filthy", "hate", "kill", "shut")
PREFIXES = (4, 5, 6)
SUBLEXICONS = 6
_YOU = re.compile(r"(?i)\byou(?:'re| are) (?:an? |so |such )?")


def entries(word: str) -> list[str]:
    """Lexicon entries that a lower-case word can match: itself and its prefixes."""
    return ["=" + word] + [f"{k}{word[:k]}" for k in PREFIXES if len(word) > k]


def document_entries(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(WORD.findall(text.lower())):
        out.update(entries(w))
    return out


class Voters:
    """Votes (1 toxic, 0 not, -1 abstains) and figures of a text, from a mined lexicon."""

    N_VOTES = SUBLEXICONS + len(PREFIXES) + 8
    N_FIGURES = 8

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.words: dict[str, tuple] = {}

    def __getstate__(self):
        return {"lexicon": self.lexicon, "words": {}}

    def _word(self, w: str) -> tuple:
        if len(self.words) > 300_000:
            self.words.clear()
        hits = [(e, self.lexicon[e]) for e in entries(w) if e in self.lexicon]
        got = (zlib.crc32(w.encode()) % SUBLEXICONS if any(e[0] == "=" for e, _ in hits) else -1, tuple(int(e[0]) for e, _ in hits if e[0] != "="), max((x for _, x in hits), default=0.0), w in SEED_WORDS)
        self.words[w] = got
        return got

    def __call__(self, text: str) -> tuple[list[int], list[float]]:
        all_words = WORD.findall(text.lower())
        n, known = len(all_words), self.words
        found = [(w, known.get(w) or self._word(w)) for w in set(all_words)]
        found = [(w, x) for w, x in found if x[2] or x[3]]
        sub, pre = [-1] * SUBLEXICONS, dict.fromkeys(PREFIXES, -1)
        seeds = 0
        for _, (group, prefixes, _, seed) in found:
            if group >= 0:
                sub[group] = 1
            for k in prefixes:
                pre[k] = 1
            seeds += seed
        strong = [(w, x[2]) for w, x in found if x[2]]
        total = sum(x for _, x in strong)
        hits = 0
        if strong:
            chosen = {w for w, _ in strong}
            hits = sum(w in chosen for w in all_words)
        shout = sum(c.isupper() for c in text) > 0.5 * max(1, len(text))
        votes = [*sub, *pre.values(), 1 if seeds else -1, 0 if not strong and not seeds else -1, 1 if len(strong) >= 2 else 0, 1 if len(strong) >= 3 else -1, 1 if len(strong) >= 4 else -1, 1 if hits >= 3 else -1, 1 if shout and strong else -1, 1 if strong and _YOU.search(text) else -1]
        figures = [math.log1p(len(strong)), math.log1p(hits), hits / max(20, n) * 10, math.log1p(total), max((x for _, x in strong), default=0.0), math.log1p(seeds), float(len(strong) >= 2), float(len(strong) >= 3)]
        return votes, figures


def _counts(sample: DataFrame) -> DataFrame:
    """entry, c0_0, c0_1, c1_0, ...: in how many rows of each fold and y it stands."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            keys = list(total)
            return pa.RecordBatch.from_arrays([pa.array([k[1] for k in keys], pa.string()), pa.array([k[0] for k in keys], pa.int32()), pa.array(list(total.values()), pa.int64())], ["entry", "slot", "n"])

        for b in batches:
            for t, y, fold in zip(texts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                slot = 2 * fold + y
                total.update((slot, e) for e in document_entries(t))
                if len(total) > 200_000:
                    yield out()
                    total.clear()
        yield out()

    each = (F.coalesce(F.sum(F.when(F.col("slot") == 2 * k + y, F.col("n"))), F.lit(0)).alias(f"c{k}_{y}") for k in range(FOLDS) for y in (0, 1))
    return sample.select("text", "y", "fold").mapInArrow(run, "entry string, slot int, n long").groupBy("entry").agg(*each)


def mine(sample: DataFrame) -> list[dict[str, float]]:
    """Log-odds of all entries that stand in toxic rows far more often: of all rows, then without each fold.

    The test runs in Spark on the counts of both classes; only entries that pass are collected.
    """
    sizes = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    odds = {}
    for left_out in (None, *range(FOLDS)):
        used = [k for k in range(FOLDS) if k != left_out]
        name = f"without{left_out}"
        n1, n0 = (sum(sizes.get((k, y), 0) for k in used) for y in (1, 0))
        if not n1 or not n0:
            odds[name] = F.lit(None).cast("double")
            continue
        a, c = (sum((F.col(f"c{k}_{y}") for k in used), F.lit(0)) for y in (1, 0))
        x = F.log((a + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1))
        odds[name] = F.when((a >= LEAST_ROWS) & (x > LEAST_ODDS), x)
    rows = _counts(sample).select("entry", *(c.alias(n) for n, c in odds.items())).where(F.coalesce(*odds).isNotNull()).collect()
    return [{r["entry"]: r[name] for r in rows if r[name] is not None} for name in odds]


def coded(votes: np.ndarray) -> np.ndarray:
    """One integer for each row of votes (-1, 0, 1)."""
    return np.where(votes < 0, 2, votes) @ 3 ** np.arange(votes.shape[1], dtype=np.int64)


def decoded(codes: np.ndarray, width: int = Voters.N_VOTES) -> np.ndarray:
    digits = np.asarray(codes, np.int64)[:, None] // 3 ** np.arange(width, dtype=np.int64) % 3
    return np.where(digits == 2, -1, digits)


def spanning_tree(weight: np.ndarray) -> np.ndarray:
    """Parents (-1: the root 0) in a tree of the greatest total weight."""
    m = len(weight)
    up, best, source, inside = np.full(m, -1), weight[0].copy(), np.zeros(m, int), np.zeros(m, bool)
    inside[0] = True
    for _ in range(m - 1):
        j = int(np.where(inside, -np.inf, best).argmax())
        up[j], inside[j] = source[j], True
        better = weight[j] > best
        best, source = np.where(better, weight[j], best), np.where(better, j, source)
    return up


class LabelModel:
    """P(y) and, for both classes, P(vote | y, vote of one other voter), by EM on weighted vote patterns.

    In each round the voters that depend on each other most, given y, are tied in a tree
    (greatest conditional mutual information), so correlated voters aren't counted twice.
    known holds -1, or the given label of anchored patterns, whose posterior stays.
    """

    def __init__(self, votes: np.ndarray, known: np.ndarray, weight: np.ndarray, rounds: int = 60):
        n, m = votes.shape
        code = np.where(votes < 0, 2, votes)
        one = np.zeros((n, 3 * m))
        one[np.repeat(np.arange(n), m), (np.arange(m) * 3 + code).ravel()] = 1
        guess = ((votes == 1).sum(1) + 0.2) / ((votes >= 0).sum(1) + 1.0)
        post = np.where(known >= 0, known, np.clip(guess, 0.02, 0.98)).astype(float)
        for self.rounds in range(1, rounds + 1):
            joint = [(one * w[:, None]).T @ one for w in ((1 - post) * weight, post * weight)]
            total = [float((w * weight).sum()) for w in (1 - post, post)]
            self.single, information, self.pair = [], np.zeros((m, m)), []
            for c in (0, 1):
                pairs, alone = (joint[c] + 1 / 3).reshape(m, 3, m, 3) / (total[c] + 3), (np.diag(joint[c]) + 1).reshape(m, 3) / (total[c] + 3)
                information += total[c] / sum(total) * (pairs * np.log(pairs / (alone[:, :, None, None] * alone))).sum((1, 3))
                self.single.append(alone)
                self.pair.append(joint[c].reshape(m, 3, m, 3))
            np.fill_diagonal(information, -1)
            self.up, self.information = spanning_tree(information), information
            self.prior = float(np.clip(total[1] / sum(total), 0.001, 0.999))
            new = np.where(known >= 0, known, self.posterior(votes))
            moved, post = float(np.abs(new - post).max(initial=0)), new
            if moved < 1e-6:
                break

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        code = np.where(votes < 0, 2, votes)
        logit = np.full(len(code), math.log(self.prior / (1 - self.prior)))
        for c, sign in ((0, -1), (1, 1)):
            for j, k in enumerate(self.up):
                alone = self.single[c][j]
                if k < 0:
                    logit += sign * np.log(alone[code[:, j]])
                else:
                    seen = self.pair[c][k, :, j, :]
                    table = (seen + 2 * alone) / (seen.sum(1, keepdims=True) + 2)
                    logit += sign * np.log(table[code[:, k], code[:, j]])
        return sigmoid(logit)


def _inputs(votes: np.ndarray, figures: np.ndarray) -> np.ndarray:
    return np.hstack([votes == 1, votes == 0, figures]).astype(float)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Pattern codes and classifier inputs of a batch of the view."""
    codes = batch.column("pattern").to_numpy()
    return codes, _inputs(decoded(codes), batch.column("figures").flatten().to_numpy(zero_copy_only=False).reshape(-1, Voters.N_FIGURES))


def _summed(view: DataFrame, f, merge=np.add) -> np.ndarray | None:
    """f of each batch of the view, merged; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = f(*_rows(b))
                total = one if total is None else merge(total, one)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = None
    for r in view.select("pattern", "figures").mapInArrow(run, "sums binary").collect():
        one = np.frombuffer(r.sums)
        total = one if total is None else merge(total, one)
    return total


class Model:
    """The fitted parts: voters of all labelled rows, label model, linear classifier."""

    def __init__(self, voters: Voters, labels: LabelModel | None, scale: Scaled | None, w: np.ndarray | None):
        self.voters, self.labels, self.scale, self.w = voters, labels, scale, w

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        if self.w is None or not len(inputs):
            return np.zeros(len(inputs))
        return sigmoid(self.scale(inputs) @ self.w)


def _voted(src: DataFrame, voters: list[Voters], carry: list[str]) -> DataFrame:
    """carry, pattern, figures of rows (carry..., voter, text); voter chooses one of voters."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = b.num_columns - 2
                got = [voters[i](t) for i, t in zip(b.column(k).to_pylist(), texts(b.column(k + 1)), strict=True)]
                v, f = np.array([g[0] for g in got]), np.array([g[1] for g in got])
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(coded(v)), list_column(f.ravel(), np.full(len(f), f.shape[1]), pa.float64())], [*b.schema.names[:k], "pattern", "figures"])

    ddl = "".join(f"{c} {src.schema[c].dataType.simpleString()}, " for c in carry)
    return src.select(*carry, "voter", "text").mapInArrow(run, f"{ddl}pattern long, figures array<double>")


def _sample(labels: DataFrame, label_col: str, max_labelled: int) -> DataFrame:
    """id, y of the labels of the smallest hashes; rows held out have no part in it."""
    lab = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    return lab.orderBy(F.xxhash64("id", F.lit(4)), "y").limit(max_labelled)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> tuple[Model, DataFrame]:
    """The model, and the stored view (id, held_out, known, pattern, figures) of all documents.

    Labels of at most max_labelled rows, those of the smallest hashes, are used; rows held
    out take part only by their texts, as all rows without a label. Vote patterns number
    at most 2 ** 17 whatever the input, so the driver fits the label model on their counts;
    the classifier's steps are passes over the view that return sums.
    """
    lab = F.broadcast(_sample(labels, label_col, max_labelled))
    src = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    sample = stored(src.join(lab, "id").select("text", "y"), "toxicity").dropDuplicates(["text", "y"]).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    voters, *folds = map(Voters, mine(sample))
    ids = lab.select("id").distinct().withColumn("known", F.lit(True))
    every = src.join(F.broadcast(ids), "id", "left").select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), F.coalesce("known", F.lit(False)).alias("known"), F.lit(0).alias("voter"), "text")
    view = stored(_voted(every, [voters], ["id", "held_out", "known"]), "votes")
    anchors = _voted(sample.withColumnRenamed("fold", "voter"), folds, ["y"]).groupBy("pattern", "y").count().collect()
    if len({r["y"] for r in anchors}) < 2:
        return Model(voters, None, None, None), view
    free = view.where("not known").groupBy("pattern").count().collect()
    own = np.array([r["count"] for r in free] + [r["count"] for r in anchors], float)
    known = np.array([-1] * len(free) + [r["y"] for r in anchors])
    if free:
        own[known >= 0] *= ANCHOR * own[known < 0].sum() / own[known >= 0].sum()
    model = LabelModel(decoded([r["pattern"] for r in [*free, *anchors]]), known, own)
    n, mean, square = np.split(_summed(view, lambda codes, x: moments(x), merged_moments), [1, 1 + 2 * Voters.N_VOTES + Voters.N_FIGURES])
    scale = Scaled(mean=mean, sd=np.sqrt(square / n))

    def sums(trial: list[np.ndarray]) -> list[np.ndarray]:
        return [_summed(view, lambda codes, x: loss_sums(scale(x), model.posterior(decoded(codes)), trial[0]))]

    (w,) = newton(sums, [np.zeros(1 + len(mean))], ridge=1e-4, rounds=25)
    return Model(voters, model, scale, w), view


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out boolean, score double in 0..1, predicted int.

    Only the text is an input of a score; null is empty and has a score too, long texts
    are read whole, equal texts have equal scores. A null doc_id isn't held out. Without
    labels of both classes all scores are 0; an empty table gives no rows. Of several
    labels of one id all count. Repeated rows and ids stay; other columns are left out
    whatever their names. Texts are read twice (the labelled ones, then all); their votes
    and few figures go to the shared folder, and fits and scores come from there.
    """
    tuned(docs.sparkSession)
    model, view = fit(docs, labels)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.scores(_rows(b)[1]), pa.float64())], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = view.select("id", "held_out", "pattern", "figures").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
