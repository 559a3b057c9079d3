"""The pipeline against its steps done plainly on a small made-up corpus."""

import pickle
import random

import numpy as np

import corpus_pipeline
from pitchlake.llm import minhash, pii, quality
from pitchlake.llm.common import BASES, powers
from pitchlake.llm.tokenizing import load, tokenizer_file

from .test_classifiers import made
from .test_neardup import brute


def corpus():
    rng = random.Random(8)
    docs, labels = made(260, seed=11)
    # words of made() are few: numbers make the texts differ
    docs = [(i, None if t is None else " ".join(f"{w}{rng.choice('abcdefghij')}" if w.isalpha() and w.islower() else w for w in t.split(" ")), *r) for i, t, *r in docs[:-1] if i is not None]
    docs.append(docs[0])  # a repeated row
    items = [" ".join("".join(rng.choices("aeinorst", k=rng.randint(3, 8))) for _ in range(25)) for _ in range(5)]
    n = max(i for i, *_ in docs) + 1
    base = [d[1] for d in docs[:40] if d[1]]
    for k in range(30):
        t = base[k]
        t = t if k % 3 == 0 else f"{t} More words stand here, mail me.{k}@host.example.org now" if k % 3 == 1 else f"{t} {items[k % 5]} and so on"
        docs.append((n + k, t, "en", f"src{k % 4}", len(t)))
    return docs, labels, items


def test_stages(spark, tmp_path):
    docs, labels, items = corpus()
    sf = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")

    good = {r.doc_id for r in quality.score(d, lab).collect() if r.kept}
    texts = {i: t for i, t, *_ in docs if i in good}
    texts = {i: texts[i] for i, _, _, kept in brute(texts, 80) if kept}
    texts = {i: t for i, t in texts.items() if not any(x in (t or "") for x in items)}
    taken = {f"{k}|{pii.votes(t, s, e, k)}" for t in texts.values() if t for s, e, k in pii.base_spans(t)}
    assert taken  # there is something to mask

    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(rows) == set(texts)
    library = load(tokenizer_file("word_bpe_49k.json"))
    for i, t in texts.items():
        plain = t or ""
        for s, e, k in reversed(pii.base_spans(plain)):
            plain = f"{plain[:s]}<{k.upper()}>{plain[e:]}"
        ids = library.encode(plain, add_special_tokens=False).ids
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == ids and rows[i].n_tokens == len(ids)
        assert rows[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_stage_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
    docs, labels, items = corpus()
    sf = f"file://{tmp_path}"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns and out.count() == 0


def test_task_functions_hold_no_tables(spark, monkeypatch):
    docs, labels, _ = corpus()
    powers(BASES[0], 1)  # the driver has this table once it has built a benchmark's index
    sent = []
    kind = type(spark.sparkContext)
    monkeypatch.setattr(kind, "broadcast", lambda self, value, f=kind.broadcast: sent.append(value) or f(self, value))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    minhash.keep_one(d.limit(60)).collect()
    assert not sent  # PySpark broadcasts functions of over 1 MB
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(quality.prepared(d, lab), lab)
    blob = pickle.dumps(model)
    assert len(blob) < model.labelled[0].nbytes + model.labelled[1].nbytes and "labelled" not in vars(pickle.loads(blob))
    assert (pickle.loads(blob).scores(*model.labelled) == model.scores(*model.labelled)).all()
