"""Operator 5: near-duplicates by chosen-path set similarity joins.

Every document is embedded as a vector of minwise tokens. In each of several
independent trees a node branches its documents by chosen coordinates of that vector;
nodes that are small enough are compared exhaustively, larger ones branch on. Links
that the vectors suggest are then confirmed on the full shingle sets.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, binary_column, byte_codes, forget, free_name, frugal, mix, powers, slices, stored, tuned, utf8
from .components import Forest, components

WORDS = 5
#: Minwise tokens per document, of 32 bits.
TOKENS = 96
#: Independent trees; chance of a second branch at a node, so that about 1/similarity paths go on.
TREES, SECOND = 10, 0.18
#: Documents of a node that are compared exhaustively; depth at which larger nodes are taken as they are.
SMALL, DEPTH = 48, 4
#: Depth to which nodes of a large group that has several classes are branched further.
FAR = 40
#: Chance of a second branch there: at the similarity asked for paths grow in number, so pairs outlive many levels.
FAR_SECOND = 0.4
#: A pair is confirmed on its sets if its vectors agree in this share less than the similarity asked for.
SLACK = 0.16
#: Documents of a group that one task confirms; larger groups are dealt out in chunks.
CHUNK, CHUNK_SHINGLES = 4096, 3_000_000
PIVOTS = 4

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts given as UTF-8, A-Z as a-z, and how many words each text has."""
    n = len(raw)
    inside = ~_SPACE[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    starts[heads] = inside[heads]  # a text's first word doesn't go on from the text before
    at = np.flatnonzero(starts)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    stop[tails] = inside[tails]
    end = np.flatnonzero(stop) + 1
    power, inverse = powers(BASES[0], n)
    acc = np.empty(n + 1, np.uint64)
    acc[0] = 0
    np.cumsum(byte_codes(71, True)[raw] * power[:n], out=acc[1:])
    return mix((acc[end] - acc[at]) * inverse[at]), np.diff(np.searchsorted(at, offsets))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than that are one shingle."""
    h, counts = word_hashes(raw, offsets)
    factor = [np.uint64(pow(BASES[1], i + 1, 2**64)) for i in range(words)]
    long = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for i in range(words):
        long += h[i : len(h) - words + 1 + i] * factor[i]
    long = mix(long)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(long[at : at + n - words + 1]))
        elif n:
            with np.errstate(over="ignore"):
                s = np.array([n], np.uint64) * np.uint64(BASES[0])
                for i in range(n):
                    s += h[at + i] * factor[i]
            out.append(mix(s ^ np.uint64(0x5555555555555555)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def tokens(sets: list[np.ndarray], k: int = TOKENS) -> np.ndarray:
    """k minwise 32-bit tokens of each set that isn't empty."""
    if not sets:
        return np.zeros((0, k), np.uint32)
    every = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    rng = np.random.default_rng(905)
    out = np.empty((len(sets), k), np.uint32)
    low = (every ^ (every >> np.uint64(29))).astype(np.uint64)
    for i, (a, b) in enumerate(rng.integers(0, 2**64, (k, 2), np.uint64)):
        x = low * (a | np.uint64(1))
        x += b
        out[:, i] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _digest(shingles: np.ndarray | bytes) -> bytes:
    return hashlib.blake2b(shingles if isinstance(shingles, bytes) else shingles.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, digest (128-bit BLAKE2 of the whole sorted set), and the packed tokens (null for an empty set), whole and as low bytes."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets(*utf8(b.column(1)))
            full = [i for i, s in enumerate(sets) if len(s)]
            vectors = tokens([sets[i] for i in full])
            packed: list[bytes | None] = [None] * len(sets)
            low: list[bytes | None] = [None] * len(sets)
            for i, v in zip(full, vectors, strict=True):
                packed[i], low[i] = v.tobytes(), v.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(packed, pa.binary()), pa.array(low, pa.binary())], ["id", "n_shingles", "digest", "tokens", "low"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, digest binary, tokens binary, low binary")


def _branch(rows: DataFrame, level: int, second: float = SECOND) -> DataFrame:
    """(node, id) of the children of each row's node (node, id, tokens); at level 0 of the roots of all trees."""
    kind = rows.schema["id"].dataType.simpleString()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(b.num_rows, -1)
            who, at = np.arange(len(v)), b.column(0).to_numpy().view(np.uint64)
            if level == 0:
                who = np.tile(who, TREES)
                at = mix(np.repeat(np.arange(1, TREES + 1, dtype=np.uint64), len(v)))
            owners, children = [], []
            for choice in (1, 2):
                h = mix(at + np.uint64(choice * 0x51ED27))
                go = np.ones(len(h), bool) if choice == 1 else (mix(h) >> np.uint64(44)).astype(float) < second * 2**20
                c = (h[go] % np.uint64(v.shape[1])).astype(np.int64)
                token = v[who[go], c].astype(np.uint64) | (c.astype(np.uint64) << np.uint64(32)) | np.uint64(choice << 48)
                owners.append(who[go])
                children.append(mix(at[go] ^ mix(token)))
            w, child = np.concatenate(owners), np.concatenate(children).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(child), b.column(1).take(pa.array(w))], ["node", "id"])

    return rows.select("node", "id", "tokens").mapInArrow(run, f"node long, id {kind}")


def _compared(rows: DataFrame, least: float, crossing: bool = False) -> DataFrame:
    """Edges (a, b) of documents of one node whose vectors agree in a share of least: some that span what they tie
    together, or with crossing all between documents of unlike class. Nodes have at most SMALL rows, or 2 * SMALL of several classes.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(0).to_numpy()
            v = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            more = (b.column(3).to_numpy(zero_copy_only=False),) if crossing else ()
            held.append((node, b.column(1).to_numpy(zero_copy_only=False), v, *more))
            joined = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(joined[0], joined[0][-1], "left"))  # the last node may go on
            if cut:
                yield tuple(x[:cut] for x in joined)
            held = [tuple(x[cut:] for x in joined)]
        if held:
            yield held[0]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def typed(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in given:
                id_type = b.schema.field("id").type
                yield b

        for node, ids, v, *group in groups(typed(batches)):
            left, right = [], []
            bound = least * v.shape[1]
            step = 0
            while True:
                step += 1
                i = np.flatnonzero(node[step:] == node[:-step]) if step < len(node) else np.zeros(0, int)
                if not len(i):
                    break
                if crossing:
                    i = i[group[0][i] != group[0][i + step]]
                for part in np.array_split(i, len(i) // 20000 + 1):
                    ok = (v[part] == v[part + step]).sum(1) >= bound
                    left.append(part[ok])
                    right.append(part[ok] + step)
            a = np.concatenate(left) if left else np.zeros(0, int)
            b = np.concatenate(right) if right else np.zeros(0, int)
            if len(a) and not crossing:
                tree = Forest(len(ids))
                tree.join(a, b)
                a, b = (np.concatenate([x[i] for x in tree.links]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a], id_type), pa.array(ids[b], id_type)], ["a", "b"])

    dealt = rows.repartition("node").sortWithinPartitions("node").select("node", "id", "low", *(["class"] if crossing else []))
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _suggested(reps: DataFrame, similarity: float) -> DataFrame:
    """Edges of all trees: reps (id, tokens, low) are branched level by level until nodes are small.

    low has one byte of each token: unlike tokens agree in it by chance once in 256.
    """
    least = max(0.3, similarity - SLACK)
    edges: list[DataFrame] = []
    rows = _branch(reps.select(F.lit(0).cast("long").alias("node"), "id", "tokens"), 0)
    for level in range(1, DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
        shared = stored(rows.join(sizes, "node"), "nodes")
        small = shared.where(F.col("n") <= SMALL).join(reps.select("id", "low"), "id")
        edges.append(stored(_compared(small.select("node", "id", "low"), least), "edges"))
        large = shared.where(F.col("n") > SMALL)
        if large.isEmpty():
            forget(shared)
            break
        if level == DEPTH:
            # alike in so many chosen tokens: one group, which the sets decide on
            edges.append(stored(large.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "edges"))
            forget(shared)
            break
        rows = stored(_branch(large.join(reps.select("id", "tokens"), "id"), level), "branches")
        forget(shared)
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def _confirm(sets: list[np.ndarray], percent: int, group: np.ndarray | None = None, outer: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links: pairs with 100 * intersection >= percent * union.

    Searched breadth first: a document is compared with all that aren't reached yet, in
    one vectorised step. With group, documents of one group count as reached from each
    other; with outer, only pairs with at least one outer document are compared.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    start = np.concatenate([[0], np.cumsum(size)])
    links = []
    left = np.ones(n, bool)
    members: dict[int, np.ndarray] = {}
    if group is not None:
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            members[int(group[part[0]])] = part
    for seed in range(n):
        if not left[seed]:
            continue
        queue = [seed] if group is None else members[int(group[seed])].tolist()
        left[queue] = False
        while queue:
            i = queue.pop()
            rest = left & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            if outer is not None and not outer[i]:
                rest &= outer
            rest = np.flatnonzero(rest)
            cuts = np.flatnonzero(np.diff(np.cumsum(size[rest]) // 500_000)) + 1
            for part in np.split(rest, cuts):
                if not len(part):
                    continue
                k = size[part]
                at = np.repeat(start[part], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                x = flat[at]
                own = sets[i]
                hit = own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(k) - k)
                ok = part[100 * common >= percent * (k + size[i] - common)]
                for j in ok.tolist():
                    if left[j]:
                        links.append((i, j))
                        new = [j] if group is None else members[int(group[j])].tolist()
                        left[new] = False
                        queue += new
    return links


def _rank(packed: bytes) -> tuple[int, bytes]:
    """n_shingles and digest of a packed set, as signed() gives them."""
    return len(packed) // 8, _digest(packed)


def _confirmed(sets: DataFrame, percent: int, grouped: bool) -> DataFrame:
    """Links within each key of rows (key, id, shingles[, component, outer])."""
    kind = sets.schema["id"].dataType.simpleString()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple] = []

        def done(rows) -> None:
            counted: dict = {}  # an id once, by the set that near_duplicates counts
            for r in rows:
                had = counted.setdefault(r[1], r)
                if had[2] != r[2] and _rank(r[2]) < _rank(had[2]):
                    counted[r[1]] = r
            rows = list(counted.values())
            if len(rows) < 2:
                return
            own = [np.frombuffer(r[2], np.uint64) for r in rows]
            group = outer = None
            if grouped:
                group = np.unique(np.array([r[3] for r in rows]), return_inverse=True)[1]
                outer = np.array([r[4] for r in rows], bool)
            links.extend((rows[i][1], rows[j][1]) for i, j in _confirm(own, percent, group, outer))

        held, key, kind_of_id = [], None, pa.int64()
        for b in batches:
            kind_of_id = b.column(1).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != key and held:
                    done(held)
                    held = []
                key = row[0]
                held.append(row)
            if len(links) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], kind_of_id) for i in (0, 1)], ["a", "b"])
                links.clear()
        done(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], kind_of_id) for i in (0, 1)], ["a", "b"])

    cols = ["key", "id", "shingles", *(["component", "outer"] if grouped else [])]
    return sets.repartition("key").sortWithinPartitions("key").select(*cols).mapInArrow(run, f"a {kind}, b {kind}")


def _shingled(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """wanted (id, ...) with the packed shingle sets of these documents."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted.hint("shuffle_merge"), "id")
    names = [c for c in src.columns if c not in ("id", "text")]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets(*utf8(b.column(1)))
            packed = binary_column(np.concatenate(sets), np.array([8 * len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([b.column(0), packed, *b.columns[2:]], ["id", "shingles", *names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields if f.name != "id")
    return src.mapInArrow(run, f"id {wanted.schema['id'].dataType.simpleString()}, shingles binary, {ddl}")


def _chunked(rows: DataFrame, *by: str) -> DataFrame:
    """by, n, chunks: into how many chunks the documents (with n_shingles) of each group are dealt."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"))


def _unsettled(reps: DataFrame, member: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left to confirm between the classes of large groups: pairs (a, b); (id, grp), documents to be
    compared with the whole class grp, which isn't theirs; (id, grp), documents to be compared with each other.

    member (id, class) is branched by the trees again, now by class: a node whose
    documents are of one class is done; small ones are compared on their vectors; one with
    at most CHUNK documents outside its largest class has these compared with each other
    and with that class; larger ones branch on until they fall apart, as groups do that
    are alike only in part. What is larger still after FAR levels is compared all the same.
    """
    pairs: list[DataFrame] = []
    whole: list[DataFrame] = []
    inside: list[DataFrame] = []
    known = member.join(reps.select("id", "tokens"), "id")
    rows = _branch(known.select(F.lit(0).cast("long").alias("node"), "id", "tokens"), 0, FAR_SECOND)
    for level in range(1, FAR + 1):
        tagged = rows.join(member, "id")
        per = tagged.groupBy("node", "class").agg(F.count("*").alias("k"))
        nodes = per.groupBy("node").agg(F.sum("k").alias("n"), F.max(F.struct("k", "class")).alias("m"), F.count("*").alias("classes")).where("n > m.k").select("node", "n", "classes", F.col("m.class").alias("main"), (F.col("n") - F.col("m.k")).alias("outside"))
        shared = stored(tagged.join(nodes, "node"), "unsettled")
        small, done = F.col("n") <= SMALL, F.lit(True) if level == FAR else F.col("outside") <= CHUNK
        pairs.append(stored(_compared(shared.where(small).join(reps.select("id", "low"), "id").select("node", "id", "low", "class"), least, True), "pairs"))
        outer = shared.where(~small & done & (F.col("class") != F.col("main")))
        # a large class is searched as a whole, once for a document, whatever nodes they share
        whole.append(stored(outer.select("id", F.col("main").alias("grp")).distinct(), "whole"))
        inside.append(stored(outer.where("classes > 2").select("id", F.col("node").alias("grp")), "inside"))
        rest = shared.where(~small & ~done).select("node", "id")
        if level == FAR or rest.isEmpty():
            forget(shared)
            break
        rows = stored(_branch(rest.join(reps.select("id", "tokens"), "id"), level, FAR_SECOND), "branches")
        forget(shared)
    one = lambda parts: functools.reduce(DataFrame.unionByName, parts).distinct()
    return one(pairs), one(whole), one(inside)


def _against(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Keys under which rows (grp, id, class, n_shingles) of outer meet those of inner of their group: id, component, outer, key.

    inner is dealt into chunks and outer into blocks, one for most groups; each chunk meets each block.
    """
    chunks, blocks = _chunked(inner, "grp").select("grp", "chunks"), _chunked(outer, "grp").select("grp", F.col("chunks").alias("blocks"))
    sizes = stored(chunks.join(blocks, "grp"), "sizes")
    place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = inner.join(sizes, "grp").withColumn("chunk", place(0, "chunks")).withColumn("block", each("blocks")).withColumn("outer", F.lit(False))
    b = outer.join(sizes, "grp").withColumn("block", place(2, "blocks")).withColumn("chunk", each("chunks")).withColumn("outer", F.lit(True))
    cols = ["id", F.col("class").alias("component"), "outer", F.xxhash64("grp", "chunk", "block").alias("key")]
    return a.select(*cols).unionByName(b.select(*cols)).groupBy("id", "key").agg(F.first("component").alias("component"), F.max("outer").alias("outer"))


def _links(docs: DataFrame, id_col: str, text_col: str, reps: DataFrame, percent: int) -> DataFrame:
    """Confirmed links that span the classes of similar representatives."""
    suggested = _suggested(reps, percent / 100)
    near = stored(components(suggested, "suggested").join(reps.select("id", "n_shingles"), "id"), "near")
    sizes = _chunked(near, "component")
    placed = near.join(sizes.select("component", "chunks"), "component")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    big = sizes.where("chunks > 1").select("component", "chunks")
    spread = not big.isEmpty()
    if spread:
        # a few documents of a large group stand in each of its chunks, and so tie them together
        w = placed.where("chunks > 1").groupBy("component").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks") * 64) == 0, F.col("id")))), 1, PIVOTS).alias("p"))
        pivots = w.select("component", F.explode("p").alias("id"))
        extra = placed.join(pivots, ["component", "id"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        placed = placed.unionByName(extra.select(placed.columns)).distinct()
    shingled = _shingled(docs, id_col, text_col, placed.select("id", F.struct("component", "chunk").alias("key")))
    links = stored(_confirmed(shingled.withColumn("key", F.xxhash64("key.component", "key.chunk")), percent, False), "links")
    if not spread:
        return links
    # second round: documents of one chunk are settled, those of unlike chunks only if they are of one class by now
    classes = components(links, "links").withColumnRenamed("component", "class")
    member = near.join(big, "component").join(classes, "id", "left").select("id", "component", F.coalesce("class", "id").alias("class"), "n_shingles")
    several = member.groupBy("component").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("component")
    member = stored(member.join(several, "component", "left_semi").select("id", "class", "n_shingles"), "large")
    if member.isEmpty():
        return links
    pairs, whole, inside = _unsettled(reps, member.select("id", "class"), max(0.3, percent / 100 - SLACK))
    stars = pairs.select(F.col("a").alias("hub"), F.col("b").alias("id")).unionByName(pairs.select(F.col("a").alias("hub"), F.col("a").alias("id")).distinct())
    links = links.unionByName(_confirmed(_shingled(docs, id_col, text_col, stars.select("id", F.xxhash64("hub", F.lit(3)).alias("key"))), percent, False))
    own = member.join(whole.select(F.col("grp").alias("class")).distinct(), "class", "left_semi").withColumn("grp", F.col("class"))
    met = _against(own, whole.join(member, "id")).unionByName(_against(inside.join(member, "id"), inside.join(member, "id")))
    return links.unionByName(_confirmed(_shingled(docs, id_col, text_col, met), percent, True))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct id: id, n_shingles long, component_id, kept boolean.

    Links are pairs of shingle sets with 100 * intersection >= percent * union; a
    component is what links reach, named by its smallest id, and kept marks that id.
    Null and empty texts have 0 shingles and link with nothing; long texts are taken
    whole. Documents of equal sets (size and 128-bit digest of the whole set) are one
    class and only its smallest id is searched for. Rows that repeat an id count once:
    the one of the smallest (n_shingles, digest). Rows with a null id are left out, an
    empty table gives no rows; extra columns are ignored whatever their names. Ids are of
    any type with an order. Sets are held as 64-bit hashes of words.
    """
    tuned(docs.sparkSession)
    docs = docs.where(F.col(id_col).isNotNull())
    all_rows = stored(signed(docs, id_col, text_col), "signed")
    once = all_rows.groupBy("id").agg(F.min(F.struct("n_shingles", "digest")).alias("k")).select("id", "k.*")
    classes = once.where("n_shingles > 0").groupBy("n_shingles", "digest").agg(F.min("id").alias("rep"))
    member = stored(once.join(classes, ["n_shingles", "digest"], "left").select("id", "n_shingles", "digest", F.coalesce("rep", "id").alias("rep")), "classes")
    own = member.where("id = rep and n_shingles > 0").select("id", "n_shingles", "digest")
    reps = stored(all_rows.join(own, ["id", "n_shingles", "digest"]).dropDuplicates(["id"]).select("id", "n_shingles", "tokens", "low"), "reps")
    forget(all_rows)
    links = _links(docs, id_col, text_col, reps, percent)
    found = components(links, "near").select(F.col("id").alias("rep"), F.col("component"))
    out = member.join(found, "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't near-duplicates of a smaller id, with all their columns.

    Rows without an id stay; rows that repeat an id and its text count once. Unlike texts
    of one id are documents of their own, in the order of their digests. Null and empty
    texts are near nothing and stay, long ones are compared whole; an empty table stays
    empty, and extra columns of any name keep their values.
    """
    own, key = free_name(docs, "_own"), free_name(docs, "_key")
    named = docs.where(F.col(id_col).isNotNull()).withColumn(own, F.coalesce(F.md5(F.col(text_col).cast("string").cast("binary")), F.lit("")))
    unlike = named.groupBy(id_col).agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b")
    if unlike.isEmpty():
        key = id_col
    else:
        keys = named.select(id_col, own).distinct().orderBy(id_col, own).withColumn(key, F.monotonically_increasing_id())
        named = named.join(stored(keys, "keys"), [id_col, own])
    drop = near_duplicates(named.select(key, text_col), percent, key, text_col).where("not kept").select(key)
    kept = named.join(drop, key, "left_anti").dropDuplicates([key]).select(*(f"`{c}`" for c in docs.columns))
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
