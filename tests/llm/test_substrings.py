import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pitchlake.llm import substrings


def brute(data, length=100):
    seen, out = set(), []
    for i in sorted(data):
        t = (data[i] or "").encode()
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeinorstéß", k=rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(4)] + ["ab" * 120, "x" * 300, prose(200)]
    data = {0: None, 1: "", 2: "short", 3: "x" * 99, 4: "y" * 100, 5: "y" * 101, 6: "Mentpa " * 60}
    for _ in range(60):
        kind = rng.randint(0, 4)
        if kind == 0:
            t = prose(rng.randint(1, 120))
        elif kind == 1:
            t = prose(rng.randint(0, 30)) + rng.choice(shared) + prose(rng.randint(0, 30)) + rng.choice(shared)
        elif kind == 2:
            t = rng.choice(list(data.values())) or ""
        elif kind == 3:
            t = list(rng.choice(list(data.values())) or "")
            for _ in range(min(len(t), rng.randint(1, 4))):
                t[rng.randrange(len(t))] = rng.choice("qwz")
            t = "".join(t)
        else:
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            t = s[a : a + rng.randint(90, 400)] + prose(3) + s[: rng.randint(90, 200)]
        data[len(data)] = t
    return data


def result(spark, data, parts=3):
    df = spark.createDataFrame([(i, t, "q", 4) for i, t in data.items()], "doc_id long, text string, place string, bucket int").repartition(parts)
    return sorted(map(tuple, substrings.digests(df).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    data = corpus(seed)
    assert result(spark, data) == brute(data)


@pytest.mark.parametrize("block", [3, 40])
def test_small_blocks_and_pieces(spark, monkeypatch, block):
    """Buckets on both sides of a block's size; repeats told within and between small batches."""
    monkeypatch.setattr(substrings, "BLOCK", block)
    monkeypatch.setattr(substrings, "LOCAL", 5)
    monkeypatch.setattr(substrings, "PIECE", 128)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(substrings, "tuned", lambda s: s)
    data = corpus(3)
    assert result(spark, data) == brute(data)


def test_repeated_rows_and_no_ids(spark):
    rows = [(1, "z" * 150), (1, "z" * 150), (None, "z" * 150), (None, "z" * 150), (2, "z" * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.repeats(df).collect())
    assert got == [(0, 0), (0, 0), (1, 149), (2, 120)]
    assert substrings.repeats(df.limit(0)).collect() == []


def test_a_passage_in_most_documents_is_a_row_per_batch(spark):
    """The census holds each repeated run once for a task, however many documents repeat it."""
    passage = " ".join(f"word{i}" for i in range(60))
    df = spark.range(300).select(F.col("id"), F.concat(F.lit(passage), F.lit(" "), F.col("id").cast("string")).alias("text")).coalesce(2)
    rows = substrings._census(df).where("kind = 0").groupBy("bucket", "context").count()
    assert rows.agg(F.max("count")).first()[0] <= 2


def test_tables_are_dropped(spark):
    before = {t.name for t in spark.catalog.listTables()}
    out = substrings.repeats(spark.createDataFrame([("b", "q" * 250), ("a", "q" * 150)], "doc_id string, text string"))
    assert {t.name for t in spark.catalog.listTables()} == before
    assert sorted((r.doc_id, r.n_removed) for r in out.collect()) == [("a", 149), ("b", 250)]


def test_very_long_text_and_many_short_ones(spark):
    rng = random.Random(6)
    long = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(200_000))
    data = {i: " ".join(rng.choices(["one", "two", "three"], k=4)) for i in range(50)} | {60: long + "|" + long[:5000], 61: "x" + long[100_000:100_150] + "y"}
    got = {r[0]: r[2] for r in result(spark, data)}
    assert got[60] == 5000 and got[61] == 150 and not any(got[i] for i in range(50))
