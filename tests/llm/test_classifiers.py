"""Operators 8 and 10: held-out accuracy on made-up corpora, and odd inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.llm import quality, toxicity
from pitchlake.llm.common import stored
from pitchlake.llm.linear import Scaled, logistic, loss_sums, newton

WORDS = "anan ther ingon tion eraea shwh onbleth reha stedor andin thely forwh".split()


def made(n=600, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(20, 120))
        bad, toxic = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "idiot", "glorf", "snarb", "vilp" + rng.choice("aeiou")]))
        text = " ".join(words).capitalize() + "."
        if bad:
            text = rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * 60), " ".join(w + "###" for w in words)])
        docs.append((i, text, rng.choice(["en", "fr", None]), f"src{rng.randrange(9)}", len(text)))
        if rng.random() < 0.7:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "src1", 0), (None, "anan ther", "en", "s", 9), (0, docs[0][1], "en", "src0", 5)]
    return docs, labels + [(None, 1, 1), (n, None, None), (0, *labels[0][1:])]


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = made()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels


def test_quality(spark, data):
    d, lab, docs, labels = data
    rows = quality.score(d, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    truth = {i: q for i, q, _ in labels if i is not None and q is not None}
    judged = [(r.kept, truth[r.doc_id]) for r in rows if r.doc_id in truth]
    assert sum(k for k, q in judged if q == 1) / sum(q == 1 for _, q in judged) > 0.98
    assert sum(not k for k, q in judged if q == 0) / sum(q == 0 for _, q in judged) > 0.9
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in rows if r.kept)


def test_toxicity(spark, data):
    d, lab, docs, labels = data
    rows = toxicity.score(d, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    truth = {i: t for i, _, t in labels if i is not None and t is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.95


def test_without_labels(spark, data):
    d, lab, _, _ = data
    few = d.limit(5)
    assert {r.score for r in quality.score(few, lab.limit(0)).collect()} == {1.0}
    assert {r.predicted for r in toxicity.score(few, lab.limit(0)).collect()} == {0}
    assert quality.score(d.limit(0), lab).collect() == [] and toxicity.score(d.limit(0), lab).collect() == []
    assert quality.keep_good(few.drop("lang", "source", "n_chars"), lab).count() <= 5


def test_quality_exchanges_over_all_unlabelled_rows(spark):
    """More rows than a bounded pool of 20,000 would hold: figures and labels come from each of them."""
    n, wide = 30_000, len(quality.content_features(""))
    good = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) > 2
    noise = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0
    content = F.array(*(noise(i) + F.when(good, 1.5).otherwise(0.0) * int(i == 20) for i in range(20, 20 + wide)))
    meta = F.array(*(noise(i) + F.when(good, 1.5).otherwise(0.0) * int(i == 50) for i in range(50, 50 + quality.N_META)))
    rows = spark.range(n).select("id", content.alias("content"), meta.alias("meta"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), (F.col("id") < 400).alias("known"), good.cast("int").alias("quality"))
    view = stored(rows.drop("quality"), "test")
    model = quality.fit(view, rows.where("known").select(F.col("id").alias("doc_id"), "quality"))
    every = np.array([r.content for r in view.select("content").collect()])
    assert np.allclose(model.sa.mean, every.mean(0)) and np.allclose(model.sa.sd, every.std(0))
    assert model.pool_rows == n - 400 and sum(map(sum, model.exchanged)) > 20_000


def test_newton_on_sums_is_the_plain_fit():
    rng = np.random.default_rng(4)
    x = np.hstack([np.ones((500, 1)), rng.normal(size=(500, 4))])
    y = (x @ [0.2, 1, -2, 0, 0.5] + rng.logistic(size=500) > 0).astype(float)
    parts = lambda w: [loss_sums(x[:200], y[:200], w[0]) + loss_sums(x[200:], y[200:], w[0])]
    for start in (np.zeros(5), np.array([9.0, -9, 9, 9, -9])):
        assert np.allclose(newton(parts, [start])[0], logistic(x, y), atol=1e-6)


def test_lexicon_keeps_rare_words_beside_many_neutral_ones(spark):
    neutral = " ".join(a + b + c for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "\u00e0\u00e1\u00e2\u00e3\u00e4\u00e5\u00e6\u00e7\u00e8\u00e9\u00ea\u00eb\u00ec\u00ed\u00ee\u00ef\u00f0\u00f1\u00f2\u00f3\u00f4\u00f5\u00f6\u00f8\u00f9\u00fa\u00fb\u00fc\u00fd\u00fe\u00ff")
    assert len(neutral.split()) > 20_000
    docs = [(i, f"{neutral} {i}" + " zqvx" * (i % 3 == 0)) for i in range(40)] + [(i, f"{neutral} {i}" if i < 50 else f"anan {i}") for i in range(40, 240)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = d.select("doc_id", (F.col("doc_id") < 40).cast("int").alias("toxic"))
    assert set(toxicity.fit(d, lab)[0].voters.lexicon) == {"=zqvx"}


def test_lexicon_floor_does_not_rise_with_the_sample(spark):
    few = [i for i in range(0, 18_000, 6) if zlib.crc32(str(i).encode()) % 4 != 2][:6]
    word = F.when(F.col("id").isin(few), " zqvx").otherwise("")
    d = spark.range(18_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("anan "), F.col("id").cast("string"), word).alias("text"))
    lab = d.select("doc_id", (F.col("doc_id") % 6 == 0).cast("int").alias("toxic"))
    assert set(toxicity.fit(d, lab)[0].voters.lexicon) == {"=zqvx"}


def plain_cotraining(every, xa, xb, y, fold, ua, ub, rounds=5, share=0.1):
    """The method on whole arrays: no passes, no sums, labels given out row by row."""
    scaled = lambda x, k: Scaled(mean=every.mean(0)[k], sd=every.std(0)[k])(x)
    ka, kb = slice(0, xa.shape[1]), slice(xa.shape[1], None)
    la, lb, pa_, pb_ = scaled(xa, ka), scaled(xb, kb), scaled(ua, ka), scaled(ub, kb)
    use = fold != quality.FOLDS - 1
    for_a, for_b, free = {}, {}, set(range(len(ua)))
    for r in range(rounds + 1):
        wa = logistic(np.vstack([la[use], *[pa_[i : i + 1] for i in for_a]]), np.array([*y[use], *for_a.values()], float))
        wb = logistic(np.vstack([lb[use], *[pb_[i : i + 1] for i in for_b]]), np.array([*y[use], *for_b.values()], float))
        if r == rounds:
            break
        sure = []
        for w, x in ((wa, pa_), (wb, pb_)):
            z = {i: float(x[i] @ w) for i in free if abs(x[i] @ w) >= quality.SURE}
            cell = {i: min(int((abs(v) - quality.SURE) / 0.01), 4095) for i, v in z.items()}
            cut = min([c for c in set(cell.values()) if sum(k >= c for k in cell.values()) <= int(share * len(ua))], default=max(cell.values(), default=0))
            sure.append({i: float(v > 0) for i, v in z.items() if cell[i] >= cut})
        for_b |= sure[0]
        for_a |= sure[1]
        free -= set(sure[0]) | set(sure[1])
    return wa, wb, len(for_b), len(for_a)


def test_quality_against_a_plain_version(spark, data):
    d, lab, docs, _ = data
    view = quality.prepared(d, lab.where("doc_id % 3 = 0"), max_labelled=60)
    model = quality.fit(view, lab.where("doc_id % 3 = 0"), max_labelled=60)
    rows = view.where("not known").toArrow()
    ua, ub = quality._matrices(rows, model.rates)
    y, every = model.labelled_y, np.hstack(quality._matrices(view.toArrow(), model.rates))
    wa, wb, by_a, by_b = plain_cotraining(every, model.labelled[0], model.labelled[1], y, model.labelled_fold, ua, ub)
    assert np.allclose(wa, model.wa, atol=2e-2) and np.allclose(wb, model.wb, atol=2e-2)
    given = np.array(model.exchanged).sum(0)
    assert abs(given[0] - by_a) <= 2 and abs(given[1] - by_b) <= 2 and by_a > 10 and by_b > 10


def test_metadata_view_tells_something(spark, data):
    d, lab, _, labels = data
    truth = {i: q for i, q, _ in labels if i is not None and q is not None}
    rows = [(r.meta_score, truth[r.doc_id]) for r in quality.score(d, lab).collect() if r.doc_id in truth]
    good, bad = [s for s, q in rows if q], [s for s, q in rows if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.8


def test_columns_of_any_name(spark, data):
    d, lab, docs, _ = data
    odd = d.limit(60).withColumn("_id", F.lit(1)).withColumn("_text", F.lit("x")).withColumn("id", F.lit(2)).withColumn("y", F.lit(0)).withColumn("known", F.lit("k")).withColumn("fold", F.lit(1)).withColumn("voter", F.lit(1))
    text = odd.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert quality.score(odd, lab).count() == 60 and toxicity.score(odd, lab).count() == 60
    assert quality.keep_good(odd, lab).columns == odd.columns
    assert toxicity.score(text, lab.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == 60


def test_very_long_and_repeated_texts(spark, data):
    d, lab, docs, _ = data
    long = " ".join(f"word{i % 977} of" for i in range(150_000))
    more = d.unionByName(spark.createDataFrame([(10**9, long, "en", None, len(long)), (10**9, long, "en", None, len(long)), (10**9 + 1, None, None, None, None)], d.schema))
    for op in (quality.score, toxicity.score):
        got = [r.score for r in op(more, lab).where("doc_id = 1000000000").collect()]
        assert len(got) == 2 and got[0] == pytest.approx(got[1], rel=1e-9) and 0 <= got[0] <= 1


def simulated(n=40_000, seed=3):
    """Votes drawn from a known model: voter 4 copies voter 3 nearly always, the others are independent given y."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.15
    right, wrong = (0.8, 0.7, 0.75, 0.6), (0.03, 0.05, 0.1, 0.15)
    votes = np.stack([np.where(rng.random(n) < np.where(y, r, w), 1, -1 if j % 2 else 0) for j, (r, w) in enumerate(zip(right, wrong, strict=True))], 1)
    votes = np.hstack([votes, np.where(rng.random(n) < 0.95, votes[:, 3], -1)[:, None]])
    return votes, y, right, wrong


def test_label_model_finds_accuracies_and_the_copied_voter():
    votes, y, right, wrong = simulated()
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(patterns, np.full(len(patterns), -1), count.astype(float), rounds=400)
    assert abs(model.prior - 0.15) < 0.02
    for j in range(4):
        assert abs(model.single[1][j][1] - right[j]) < 0.05 and abs(model.single[0][j][1] - wrong[j]) < 0.03
    assert {3, 4} in [{j, int(k)} for j, k in enumerate(model.up)]
    # the posterior is that of the true model, found by counting
    post = model.posterior(patterns)
    true = np.array([y[(votes == p).all(1)].mean() for p in patterns])
    assert (count * np.abs(post - true)).sum() / count.sum() < 0.02


def test_label_model_against_a_plain_version():
    """One E and M step, sum by sum."""
    votes, _, _, _ = simulated(300, 8)
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    known = np.full(len(patterns), -1)
    known[:4] = [0, 1, 1, 0]
    weight = count.astype(float)
    model = toxicity.LabelModel(patterns, known, weight, rounds=1)
    start = [float(k) if k >= 0 else min(0.98, max(0.02, (sum(v == 1 for v in p) + 0.2) / (sum(v >= 0 for v in p) + 1))) for p, k in zip(patterns.tolist(), known, strict=True)]
    total = [sum(w * (1 - s) for w, s in zip(weight, start, strict=True)), sum(w * s for w, s in zip(weight, start, strict=True))]
    for p, got in zip(patterns.tolist(), model.posterior(patterns), strict=True):
        logs = []
        for c in (0, 1):
            share = [w * (s if c else 1 - s) for w, s in zip(weight, start, strict=True)]
            log = np.log(total[c] / sum(total))
            for j, k in enumerate(model.up.tolist()):
                alone = (sum(s for s, q in zip(share, patterns.tolist(), strict=True) if q[j] == p[j]) + 1) / (total[c] + 3)
                if k >= 0:
                    both = sum(s for s, q in zip(share, patterns.tolist(), strict=True) if q[j] == p[j] and q[k] == p[k])
                    given = sum(s for s, q in zip(share, patterns.tolist(), strict=True) if q[k] == p[k])
                    alone = (both + 2 * alone) / (given + 2)
                log += np.log(alone)
            logs.append(log)
        assert abs(got - 1 / (1 + np.exp(logs[0] - logs[1]))) < 1e-9


def test_labels_do_not_vote(spark, data):
    """Labels turned round on rows that are held out change no score."""
    d, lab, _, _ = data
    turned = lab.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r.doc_id or -1, round(r.score, 9)) for r in toxicity.score(d, lab).collect()) == sorted((r.doc_id or -1, round(r.score, 9)) for r in toxicity.score(d, turned).collect())
