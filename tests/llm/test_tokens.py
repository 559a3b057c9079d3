"""Operators 3 and 6 against the library on whole texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from pitchlake.llm import bpe, tokencount
from pitchlake.llm.common import slices
from pitchlake.llm.tokenizing import load, tokenizer_file

ODD = [
    None, "", " ", "\n\n  x", "Hello, it's WE'LL 42!! don't", "<|endoftext|> a <|startoftext|>b", "é\u0301 e\u0301 ﬁ ½ ²x", "İstanbul ŞİŞLİ ǅ ŉ",
    "日本語 текст עברית", "a\u00a0b\u2003c\x1cd\x85e", "'S 's 'tis ''ll", "tab\t\ttab \r\n end  ", "🙂🙂 ok", "x" * 5000, "“quoted” – dash — …", "soft\u00adhyphen", "<| not special |>", "\x00\x01 ctrl",
]


def rows():
    rng = random.Random(5)
    alphabet = "abcXYZ éßñ 019 .,'!-\n\t  st"
    return list(enumerate(ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 300))) for _ in range(60)])) + [(0, None), (4, ODD[4])]


def frame(spark, data):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in data], "doc_id long, text string, n_tokens string, content int")


def test_bpe_matches_library(spark):
    t = load(tokenizer_file("word_bpe_49k.json"))
    out = bpe.encode(frame(spark, rows())).collect()
    assert len(out) == len(rows())
    want = sorted((i, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows())
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in out)
    assert got == want
    assert sorted((r.doc_id, r.decoded) for r in out) == sorted((i, t.decode(ids, skip_special_tokens=False)) for i, ids in want)
    again = bpe.decode(bpe.encode(frame(spark, rows())).withColumnRenamed("decoded", "first")).collect()
    assert all(r.first == r.decoded for r in again)
    d = bpe.digests(frame(spark, [(7, "ab cd")])).first()
    ids = t.encode("ab cd", add_special_tokens=False).ids
    assert (d.n_tokens, d.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_counts_match_library_and_use_the_cache(spark, tmp_path):
    t = load(tokenizer_file("byte_bpe_50k.json"))
    cache = f"file://{tmp_path}/cache"
    want = sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows())
    half = tokencount.token_counts(frame(spark, rows()[:30]), cache)
    assert half.count() == 30
    stored = spark.read.parquet(cache).count()
    assert sorted(map(tuple, tokencount.token_counts(frame(spark, rows()), cache).collect())) == want
    assert stored < spark.read.parquet(cache).count() == len({x or "" for _, x in rows()})
    n = spark.read.parquet(cache).count()
    assert sorted(map(tuple, tokencount.token_counts(frame(spark, rows()), cache).collect())) == want
    assert spark.read.parquet(cache).count() == n


@pytest.mark.parametrize("op", [bpe.encode, tokencount.token_counts])
def test_empty_table(spark, op):
    assert op(frame(spark, [])).collect() == []


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    """Words of many chunks are one row of the table each; results don't depend on the chunks."""
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 500)
    monkeypatch.setattr(bpe, "BUCKETS", 7)
    data = rows() + [(100 + i, f"common words {i} and more common words") for i in range(300)]
    df = frame(spark, data).repartition(5)
    chunks = bpe._chunks(df.select("doc_id", "text"))
    used = bpe._words(chunks)
    assert chunks.select("chunk").distinct().count() > 10 and used.groupBy("chunk", "word").count().where("count > 1").isEmpty()
    path = tokenizer_file("word_bpe_49k.json")
    t = load(path)
    back = bpe._encoded(used, path).join(used, ["chunk", "n"]).collect()
    assert len(back) == used.count() and all(np.frombuffer(r.ids, bpe._packing(path)).tolist() == t.encode(r.word, add_special_tokens=False).ids for r in back)
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe.encode(df).collect())
    assert got == sorted((i, (ids := t.encode(x or "", add_special_tokens=False).ids), t.decode(ids, skip_special_tokens=False)) for i, x in data)


def test_null_ids_and_only_unusual_texts(spark):
    df = spark.createDataFrame([(None, "日本語"), (None, "日本語"), (3, None)], "doc_id long, text string")
    t = load(tokenizer_file("word_bpe_49k.json"))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in bpe.encode(df).collect()) == [(0, len(t.encode("日本語", add_special_tokens=False).ids))] * 2 + [(3, 0)]


def test_last_step_splits_each_text_once(monkeypatch):
    path = tokenizer_file("word_bpe_49k.json")
    t, data = load(path), rows()
    own = pa.table({"id": pa.array([i for i, _ in data], pa.int64()), "text": pa.array([x for _, x in data], pa.string())})
    names = bpe._distinct(own.column("text"))
    n = list(range(len(names)))[::-1]  # in any order
    words = pa.table({"n": pa.array(n, pa.int32()), "ids": pa.array([np.array(t.encode(names[i], add_special_tokens=False).ids, bpe._packing(path)).tobytes() for i in n], pa.binary())})
    split, asked = bpe.pre_split, []
    monkeypatch.setattr(bpe, "pre_split", lambda text, kind: asked.append(text) or split(text, kind))
    monkeypatch.setattr(bpe, "slices", lambda batches, text: slices(batches, text, 400))
    got = bpe._put_back(own, words, path).to_pylist()
    assert asked == [x or "" for _, x in data]
    want = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in data]
    assert [(r["id"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got] == [(i, len(ids), ids, t.decode(ids, skip_special_tokens=False)) for i, ids in want]
    with pytest.raises(ValueError):
        bpe._put_back(own, words.slice(1), path)
