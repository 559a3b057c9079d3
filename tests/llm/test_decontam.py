import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from pitchlake.llm import decontam


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeinorst", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(rng.randint(12, 60)) for _ in range(15)] + ["too short", None, "Éa " + prose(20)]
    docs = [None, "", "x", prose(3000)]
    want = [set(), set(), set(), set()]
    for i, t in enumerate(items):
        if not t or len(t) < 45:
            continue
        variants = [t, t.upper().replace("É", "é") if i % 2 else t.replace(" ", ",\n "), t[5:]]
        edited = list(t)
        for k in range(15, len(edited), 40):  # 2 in each window of 80
            edited[k] = rng.choice("zxq")
        variants.append("".join(edited))
        for v in variants:
            docs.append(prose(rng.randint(0, 200)) + " " + v + " " + prose(rng.randint(0, 100)))
            want.append({i})
        torn = list(t)
        for k in range(0, len(torn), 9):
            torn[k] = "z"
        docs.append(prose(50) + "".join(torn))
        want.append(set())
    docs.append(" ".join(x for x in items if x))
    want.append({i for i, x in enumerate(items) if x and len(x) >= 45})
    return items, docs, want


def frames(spark, items, docs):
    b = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    d = spark.createDataFrame([(i, t, "q") for i, t in enumerate(docs)], "doc_id long, text string, items string")
    return d, b


def test_planted_passages(spark, monkeypatch):
    items, docs, want = corpus()
    d, b = frames(spark, items, docs)
    got = {r.doc_id: r for r in decontam.matches(d, b).collect()}
    for i, w in enumerate(want):
        assert set(got[i]["items"]) == w, (i, docs[i], w)
        assert got[i].contaminated == bool(w) and got[i].n_items == len(w)
    clean = sorted(r.doc_id for r in decontam.keep_clean(d, b).collect())
    assert clean == [i for i, w in enumerate(want) if not w]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert {r.doc_id: set(r["items"]) for r in decontam.matches(d, b).collect()} == dict(enumerate(want))


def test_empty(spark):
    d, b = frames(spark, [], ["abc"])
    assert [r.contaminated for r in decontam.matches(d, b).collect()] == [False]
    assert decontam.matches(d.limit(0), b).collect() == []


def within(part, region, k):
    row = [0] * (len(region) + 1)
    for i, c in enumerate(part):
        new = [i + 1]
        for j, r in enumerate(region):
            new.append(min(row[j] + (c != r), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row) <= k


def test_band_alignment_against_full_alignment():
    rng = random.Random(7)
    for _ in range(400):
        part = bytes(rng.choices(b"abcd", k=30))
        copy = bytearray(part)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(copy))
            rng.choice([lambda: copy.__setitem__(at, 120), lambda: copy.insert(at, 121), lambda: copy.__delitem__(at)])()
        region = bytes(rng.choices(b"wxyz", k=6)) + bytes(copy) + bytes(rng.choices(b"wxyz", k=6))
        assert decontam.aligned(part, region, 3, 8, 4) == within(part, region, 4)


def test_excerpts_at_all_offsets(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices("aeinorst", k=rng.randint(2, 9))) for _ in range(n))
    item = prose(60)
    docs = [prose(9) + "qq" + item[s : s + 80] + "zz" + prose(9) for s in range(len(item) - 79)]
    for s in range(0, len(item) - 79, 7):  # and with four edits each
        part = list(item[s : s + 80])
        part[20], part[40] = "x", "y"
        del part[60]
        part.insert(30, "w")
        docs.append(prose(5) + "qq" + "".join(part) + "zz" + prose(5))
    got = decontam.matches(*frames(spark, [item], docs)).collect()
    assert [r.doc_id for r in got if not r.contaminated] == []


def test_windows_against_full_alignment():
    rng = random.Random(5)
    found = 0
    for _ in range(150):
        item = bytes(rng.choices(b"abcdefgh", k=150))
        s, n, e = rng.randrange(60), rng.randint(76, 90), rng.randint(0, 6)
        copy = bytearray(item[s : s + n])
        for _ in range(e):
            at = rng.randrange(len(copy))
            rng.choice([lambda: copy.__setitem__(at, 120), lambda: copy.insert(at, 121), lambda: copy.__delitem__(at)])()
        doc = bytes(rng.choices(b"wxyz", k=9)) + bytes(copy) + bytes(rng.choices(b"wxyz", k=9))
        want = any(within(item[x : x + 80], doc, 4) for x in range(max(0, s - 8), min(71, s + 16)))
        index = decontam.Index.mapped(np.frombuffer(decontam.Index([(3, item.decode())]).packed(), np.uint8))
        assert bool(index.search(np.frombuffer(doc, np.uint8), np.array([0, len(doc)]))) == want
        found += want
    assert 30 < found < 150


def test_short_items_match_verbatim(spark):
    items = ["Name the largest moon", "of the cat"]
    docs = ["quiz: name the LARGEST moon?", "name the largest moons", "rename the largest moon", "name the larger moon", "of the cat"]
    got = decontam.matches(*frames(spark, items, docs)).collect()
    assert {r.doc_id: r["items"] for r in got} == {0: [0], 1: [], 2: [], 3: [], 4: []}


def plain_normal(text):
    out = []
    for c in text:
        keep = unicodedata.category(c)[0] in "LMN"
        if keep:
            low = c.lower()
            out.append(low if len(low) == 1 else c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


def plain_match(item, doc):
    """The definition, window by window: a whole search without an index."""
    part, doc = plain_normal(item).rstrip(" "), plain_normal(doc)
    if len(part) < decontam.Q:
        return False
    if len(part) < decontam.MIN_CHARS:
        return any(doc.startswith(part, i) and doc[i - 1 : i] in ("", " ") and doc[i + len(part) : i + len(part) + 1] in ("", " ") for i in range(len(doc)))
    size = min(len(part), decontam.WINDOW)
    k = int(decontam.EDIT_RATE * size)
    while size + 1 - decontam.Q - k * decontam.Q < 1:
        k -= 1
    return any(within(part[s : s + size], doc, k) for s in range(len(part) - size + 1))


def test_whole_search_against_brute_force(spark):
    """Documents with torn, edited, accented and moved excerpts; every pair is compared with the definition."""
    rng = random.Random(23)
    letters = "aeinorstéßЖя日"
    prose = lambda n: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))
    items = [prose(n) for n in (2, 4, 7, 9, 14, 18, 22, 30)] + ["", "Où, Où?"]
    docs = [None, "", prose(40)]
    for item in items * 8:
        a = rng.randint(0, max(0, len(item) - 60))
        part = list(item[a : a + rng.choice([50, 82, 95, 400])])
        for _ in range(rng.choice([0, 0, 1, 3, 4, 5, 6])):
            if part:
                at = rng.randrange(len(part))
                rng.choice([lambda: part.__setitem__(at, rng.choice("éÉxЖ")), lambda: part.insert(at, "z"), lambda: part.__delitem__(at)])()
        text = "".join(part)
        docs.append(f"{prose(rng.randint(0, 6))} {text.upper() if rng.random() < 0.3 and 'ß' not in text else text} {prose(rng.randint(0, 6))}")
    d, b = frames(spark, items, docs)
    got = {r.doc_id: set(r["items"]) for r in decontam.matches(d, b).collect()}
    want = {i: {j for j, item in enumerate(items) if t and plain_match(item, t)} for i, t in enumerate(docs)}
    assert got == want and sum(map(bool, want.values())) > 15


def test_an_accent_is_one_edit(spark):
    item = "le théâtre où la fête était célébrée après la récolte des pêchers à côté du château doré"
    doc = "xx " + item.replace("é", "e", 4) + " yy"
    assert [r.contaminated for r in decontam.matches(*frames(spark, [item], [doc])).collect()] == [True]


def test_odd_rows(spark):
    """Null ids, repeated rows, a very long text, clashing columns, an empty benchmark."""
    rng = random.Random(2)
    long = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(120_000))
    item = "the quick brown fox jumps over the lazy dog and runs away from the very big bear"
    rows = [(None, item, 1), (None, item, 1), (4, None, 1), (5, long + " " + item.upper(), 1), (5, long + " " + item.upper(), 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, contaminated int").withColumn("_text", F.lit(3)).withColumn("id", F.lit("z"))
    b = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.contaminated, r["items"]) for r in decontam.matches(d, b).collect())
    assert got == [(0, True, [1]), (0, True, [1]), (4, False, []), (5, True, [1]), (5, True, [1])]
    kept = decontam.keep_clean(d, b)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [4]
    assert decontam.keep_clean(d, b.limit(0)).count() == 5 and not any(r.contaminated for r in decontam.matches(d, b.limit(0)).collect())
