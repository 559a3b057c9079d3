import random

import pytest
from pyspark.sql import functions as F

from pitchlake.llm import minhash
from pitchlake.llm.components import components


def words_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]


def shingles(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(data, percent):
    ids = sorted(data)
    sets = {i: shingles(data[i]) for i in ids}
    comp = {i: i for i in ids}
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return sorted((i, len(sets[i]), comp[i], comp[i] == i) for i in ids)


def corpus(seed, groups=12, n=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)  # stands in many documents that aren't alike
    data = {0: None, 1: "", 2: " \t\n", 3: "one two", 4: "ONE  two", 5: "one two three", 6: "É x", 7: "é x", 8: "a\x1cb c d e f", 9: "a b c d e f"}
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(8, 300)) + passage * rng.randint(0, 1)
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            data[len(data)] = rng.choice([" ", "\n", "  "]).join(w.upper() if rng.random() < 0.3 and w.isascii() else w for w in copy)
    return data


def run(spark, data, percent):
    rows = [(i, t, "x", 1) for i, t in data.items()]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, tokens string, component int")
    return sorted(map(tuple, minhash.near_duplicates(df, percent).collect()))


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, percent):
    data = corpus(percent)
    assert run(spark, data, percent) == brute(data, percent)


def test_large_groups_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 7)
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "DEPTH", 3)
    data = corpus(4, groups=3, n=30)
    assert run(spark, data, 85) == brute(data, 85)


def test_keep_one_and_empty(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "x"), (1, "A b c d e f", "y"), (None, "q", "z"), (None, "q", "z"), (9, None, None), (9, None, None)], "doc_id long, text string, key string")
    out = minhash.keep_one(df)
    assert sorted((r.doc_id or 0, r.key or "") for r in out.collect()) == [(0, "z"), (0, "z"), (1, "y"), (9, "")]
    assert minhash.near_duplicates(df.limit(0)).collect() == [] and out.columns == df.columns


@pytest.mark.parametrize("in_one_task", [500_000, 0])
def test_components(spark, monkeypatch, in_one_task):
    monkeypatch.setattr("pitchlake.llm.components.ONE_TASK", in_one_task)
    rng = random.Random(2)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(40)], [(rng.randrange(200), rng.randrange(200)) for _ in range(120)], [(0, i) for i in range(1, 50)]):
        up = {}

        def find(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
        want = sorted((x, find(x)) for x in up)
        assert sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == want


def test_unlike_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 40), ("b", 30), ("c", 20)))
    rows = [(5, a), (5, b), (5, b), (7, a + " end"), (8, c), (2, b.upper()), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in minhash.keep_one(df).collect()) == sorted([(5, a), (2, b.upper()), (8, c), (0, c)])


def test_links_are_confirmed_on_the_counted_text(spark):
    small, large = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(60))
    for texts in ((small, large), (large, small)):
        df = spark.createDataFrame([(1, small + " end"), *((2, t) for t in texts)], "doc_id long, text string").coalesce(1)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 80).collect()} == {1: 1, 2: 1}


def edited_pairs(n, seed):
    """Pairs (id, id + 1) of texts whose words differ in places chosen at random, each pair of words of its own."""
    rng = random.Random(seed)
    data = {}
    for i in range(0, 2 * n, 2):
        words = [f"p{i}w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 400))]
        copy = list(words)
        for at in rng.sample(range(len(words)), rng.randint(0, max(1, len(words) // 45))):
            copy[at] = "other"
        data[i], data[i + 1] = " ".join(words), " ".join(copy)
    return data


def test_recall_by_similarity(spark):
    """Of pairs at 0.85 and more all are found, in every bin of similarity; none below."""
    data = edited_pairs(1500, 12)
    got = {r[0]: r[2] for r in run(spark, data, 85)}
    bins = {}
    for i in range(0, len(data), 2):
        a, b = shingles(data[i]), shingles(data[i + 1])
        both = len(a & b)
        linked = 100 * both >= 85 * (len(a) + len(b) - both)
        assert linked or got[i + 1] == i + 1
        if linked:
            bins.setdefault(int(100 * both / (len(a) + len(b) - both)) // 5, []).append(got[i + 1] == i)
    assert len(bins) >= 3 and sum(map(len, bins.values())) > 800
    assert all(sum(found) >= 0.99 * len(found) for found in bins.values()), {k: (sum(v), len(v)) for k, v in bins.items()}


def test_template_pages_and_a_mass_of_copies(spark, monkeypatch):
    """Pages alike in two thirds, none of them linked, beside near copies of each other, in chunks: nothing is missed or tied."""
    monkeypatch.setattr(minhash, "CHUNK", 25)
    monkeypatch.setattr(minhash, "SMALL", 8)
    monkeypatch.setattr(minhash, "DEPTH", 2)
    rng = random.Random(31)
    template = [f"t{i}" for i in range(160)]
    data = {i: " ".join(template + [f"own{i}x{j}" for j in range(rng.randint(28, 34))]) for i in range(70)}
    base = [f"c{i}" for i in range(200)]
    for i in range(200, 250):
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(0, 3)):
            copy[at] = f"e{i}"
        data[i] = " ".join(copy)
    assert run(spark, data, 85) == brute(data, 85)


def test_string_ids_and_columns_of_any_name(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [("b", words, 1), ("a", words + " end", 2), ("c", "other text that has more than five words", 3), ("d", "", 4), ("c2", None, 5)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _own int").withColumn("_key", F.lit("k")).withColumn("id", F.lit(0))
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == [("a", "a"), ("b", "a"), ("c", "c"), ("c2", "c2"), ("d", "d")]
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r._own, r._key) for r in kept.collect()) == [("a", 2, "k"), ("c", 3, "k"), ("c2", 5, "k"), ("d", 4, "k")]
    twice = minhash.keep_one(df.unionByName(df.withColumn("text", F.lit("quite another text of six words"))))
    assert {r._own for r in twice.collect()} <= {1, 2, 3, 4, 5}


def test_very_long_text(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    data = {3: long, 9: long + " more", 11: "x " + long[: len(long) // 3], 12: "short one"}
    got = {r[0]: r[1:] for r in run(spark, data, 85)}
    assert got[9][1] == 3 and got[11][1] == 11 and got[9][0] == len(shingles(data[9]))


def test_rounds_over_many_edges(spark, monkeypatch):
    """The rounds and the one task agree on a large random graph with long paths and hubs."""
    rng = random.Random(17)
    edges = [(rng.randrange(30_000), rng.randrange(30_000)) for _ in range(24_000)] + [(i, i + 1) for i in range(40_000, 40_300)] + [(50_000, i) for i in range(50_001, 53_000)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = sorted(map(tuple, components(df).collect()))
    monkeypatch.setattr("pitchlake.llm.components.ONE_TASK", 1000)
    assert sorted(map(tuple, components(df).collect())) == one
