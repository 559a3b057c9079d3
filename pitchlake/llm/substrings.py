"""Operator 4: bytes covered by long strings that occurred before.

Blockwise, as when a suffix array is built bucket by bucket, but with a cover that
follows the content instead of fixed residues: the anchor of a window of LENGTH bytes
is the position of its smallest q-gram, so equal windows have their anchor at the same
place, and a bucket holds the suffixes of windows with one anchor q-gram. Only about one
position in 35 is an anchor, where a fixed difference cover samples one in 7 and needs a
bucket for each of the several samples in a window.

Runs of windows that share an anchor and are equal as a whole are settled by one hash
each. Windows of the other runs are sorted by their bytes, one block of buckets at a
time; no comparison goes deeper than LENGTH bytes, so there are no longer ties that
ranks of cover samples would have to resolve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, frugal, list_column, mix, prefix_sums, slices, spans, stored, tuned, utf8

LENGTH = 100
Q = 32
#: Longest piece of a text whose windows are taken at once; positions in it fit into the low bits of a sort key.
PIECE = 4 << 20
#: Contexts of buckets sorted at once; a bucket with more is dealt out by its windows instead.
BLOCK = 20_000
#: Runs of a task among which repeats are told before the shuffle.
LOCAL = 400_000
#: Bytes of text in a bucket of the text table.
BUCKET_BYTES = 16 << 20
_LOW = np.uint64(0xFFFFFF)


def runs(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, how many, anchor - first, bucket and context hashes.

    raw holds whole texts one after another; windows don't cross them.
    """
    out = []
    first = prefix_sums(raw, 0)
    second = prefix_sums(raw, 1)
    for begin in range(0, max(0, len(raw) - length + 1), PIECE):
        end = min(len(raw), begin + PIECE + length - 1)
        n = end - begin - length + 1
        at = np.arange(begin, end - q + 1)
        h = spans(first, at, at + q)
        key = (h & ~_LOW) | (_LOW - (at - begin).astype(np.uint64))
        wide, low = length - q + 1, key
        size = 1
        while 2 * size <= wide:  # low[i]: smallest key of size positions from i
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        rest = wide - size
        low = np.minimum(low[: len(low) - rest], low[rest:])[:n]
        anchor = (_LOW - (low & _LOW)).astype(np.int64)
        start = np.arange(begin, begin + n)
        text = np.searchsorted(offsets, start, "right") - 1
        fits = start + length <= offsets[text + 1]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~fits[:-1]
        new &= fits
        s = np.flatnonzero(new)
        # a run ends at the next run or where its text ends
        stop = np.append(s[1:], n)
        stop = np.minimum(stop, offsets[text[s] + 1] - length + 1 - begin)
        count, off = stop - s, anchor[s] - s
        where = s + begin
        context = mix(spans(second, where, where + count - 1 + length, 1) ^ mix((count * 256 + off).astype(np.uint64)))
        out.append((where, count, off, h[anchor[s]], context))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate([x[i] for x in out]) for i in range(5))


def _first_of_each(ids: np.ndarray, place: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether a row is the smallest (id, place) of its keys."""
    rank = np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((place, rank, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


def _merged(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and bounds of the unions of ranges that touch, id by id."""
    rank = np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((start, rank))
    rank, start, end = rank[order], start[order], end[order]
    new = np.ones(len(order), bool)
    new[1:] = (rank[1:] != rank[:-1]) | (start[1:] > end[:-1])  # runs of one text don't overlap
    at = np.flatnonzero(new)
    return order[at], start[at], np.maximum.reduceat(end, at) if len(at) else end[:0]


#: What a row of a census stands for: a run that the others of its bucket decide on; a range of
#: windows [bucket, context) that is known to be repeated.
_RUN, _KNOWN = 0, 1


def _census(docs: DataFrame) -> DataFrame:
    """deal, kind, bucket, context, id, place of every run; place packs first window, count and anchor.

    Of equal runs of one batch only the first has to be compared with other tasks'; the
    rest are repeats whatever these hold, and go on as ranges. So a passage that stands in
    a third of all documents is a row per batch, not one per document.
    """
    kind = docs.schema["id"].dataType.simpleString()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            bucket, context, place = (np.concatenate([h[i] for h in held]) for i in range(3))
            ids = pa.concat_arrays([h[3] for h in held])
            plain = ids.to_numpy(zero_copy_only=False)
            first = _first_of_each(plain, place, context, bucket)
            again = np.flatnonzero(~first)
            row, start, end = _merged(plain[again], place[again] >> 16, (place[again] >> 16) + (place[again] >> 8 & 255))
            at = np.flatnonzero(first)
            take = np.concatenate([at, again[row]])
            what = np.repeat(np.array([_RUN, _KNOWN], np.int8), (len(at), len(row)))
            bucket, context = np.concatenate([bucket[at], start]), np.concatenate([context[at], end])
            deal = np.where(what == _RUN, bucket, mix((place[take] ^ (take << 20)).view(np.uint64)).view(np.int64))
            for k in range(0, len(take), 50_000):
                cut = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(deal[cut]), pa.array(what[cut]), pa.array(bucket[cut]), pa.array(context[cut]), ids.take(pa.array(take[cut])), pa.array(place[take[cut]])], ["deal", "kind", "bucket", "context", "id", "place"])

        held, rows = [], 0
        for b in slices(batches, "text"):
            raw, offsets = utf8(b.column(1))
            where, count, off, bucket, context = runs(raw, offsets)
            text = np.searchsorted(offsets, where, "right") - 1
            place = ((where - offsets[text]) << 16) | (count << 8) | off
            held.append((bucket.view(np.int64), context.view(np.int64), place, b.column(0).take(pa.array(text))))
            rows += len(where)
            if rows >= LOCAL:
                yield from out(held)
                held, rows = [], 0
        if rows:
            yield from out(held)

    return docs.mapInArrow(run, f"deal long, kind byte, bucket long, context long, id {kind}, place long")


#: Kinds of a settled row: the first of its context in a bucket with others; a run that is
#: repeated; a range [bucket, place) that is.
_FIRST, _REPEAT, _RANGE = 0, 1, 2


def _settled(census: DataFrame) -> DataFrame:
    """bucket, id, place, kind: repeats, and the first runs of contexts whose bucket has several.

    Rows come in order of bucket, context, id, place; only the last row and one that
    waits for a second context are kept between batches, however large a bucket is.
    """
    kind = census.schema["id"].dataType.simpleString()
    dealt = census.repartition("deal").sortWithinPartitions("kind", "bucket", "context", "id", "place")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, context
        several = False  # the last bucket has more than one context
        waiting = None  # first row of the last bucket

        def rows(b: pa.RecordBatch, at: np.ndarray, what: np.ndarray) -> pa.RecordBatch:
            take = pa.array(at)
            return pa.RecordBatch.from_arrays([b.column("bucket").take(take), b.column("id").take(take), b.column("place").take(take), pa.array(what.astype(np.int8))], ["bucket", "id", "place", "kind"])

        for b in batches:
            known = np.flatnonzero(b.column("kind").to_numpy() == _KNOWN)
            if len(known):
                take = pa.array(known)
                yield pa.RecordBatch.from_arrays([b.column("bucket").take(take), b.column("id").take(take), b.column("context").take(take), pa.array(np.full(len(known), _RANGE, np.int8))], ["bucket", "id", "place", "kind"])
                b = b.slice(0, int(known[0]))  # these come last
            n = b.num_rows
            if not n:
                continue
            bucket, context = b.column("bucket").to_numpy(), b.column("context").to_numpy()
            new_bucket = np.ones(n, bool)
            new_bucket[1:] = bucket[1:] != bucket[:-1]
            leads = new_bucket.copy()
            leads[1:] |= context[1:] != context[:-1]
            goes_on = last is not None and last[0] == bucket[0]
            if goes_on:
                new_bucket[0] = False
                leads[0] = last[1] != context[0]
            group = np.cumsum(new_bucket)  # 0: the bucket that goes on from the batch before
            contexts = np.bincount(group, weights=leads, minlength=int(group[-1]) + 1)
            own = contexts >= 2
            if goes_on:
                own[0] = several or contexts[0] >= 1
                if own[0] and waiting is not None:
                    yield waiting
                    waiting = None
            at = np.flatnonzero(~leads | own[group])
            if len(at):
                yield rows(b, at, np.where(leads[at], _FIRST, _REPEAT))
            if group[-1] > 0 or not goes_on:
                waiting = None
                several = bool(own[group[-1]])
                if not several:
                    waiting = rows(b, np.flatnonzero(new_bucket)[-1:], np.array([_FIRST]))
            else:
                several = bool(own[0])
            last = (bucket[-1], context[-1])

    return dealt.mapInArrow(run, f"bucket long, id {kind}, place long, kind byte")


def _contexts(text: DataFrame, firsts: DataFrame) -> DataFrame:
    """bucket, id, place and bytes of runs whose windows have to be compared."""
    # (bucket, place) as one array per text: the join to the bucketed texts shuffles none of these
    grouped = firsts.groupBy("id").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("place").alias("places"))
    src = text.join(grouped, "id").select("id", "text", "buckets", "places")
    kind = text.schema["id"].dataType.simpleString()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            blobs, rows, buckets, places = [], [], [], []
            for i, (t, bs, ps) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                t = t.encode()
                for bucket, place in zip(bs, ps, strict=True):
                    s = place >> 16
                    blobs.append(t[s : s + (place >> 8 & 255) - 1 + LENGTH])
                    rows.append(i)
                    buckets.append(bucket)
                    places.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), b.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "id", "place", "blob"])

    return src.mapInArrow(run, f"bucket long, id {kind}, place long, blob binary")


def _windows(place: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs' bytes; of every window its run, its number in it and where its bytes begin."""
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    begin = np.cumsum([0, *map(len, blobs[:-1])])
    count = place >> 8 & 255
    row = np.repeat(np.arange(len(blobs)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return raw, row, step, begin[row] + step


def repeated_windows(bucket: np.ndarray, place: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end of runs of windows that stand earlier in their bucket; rows are in order.

    Windows whose hash no other window of the bucket has are put aside; the rest are sorted
    by bucket and bytes, and each that equals the one before it is a repeat.
    """
    raw, row, step, at = _windows(place, blobs)
    h = spans(prefix_sums(raw, 0), at, at + LENGTH) ^ mix(bucket.view(np.uint64))[row]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    tied = np.zeros(len(row), bool)
    tied[order[1:]] |= same
    tied[order[:-1]] |= same
    again = np.zeros(len(row), bool)
    at_tied = np.flatnonzero(tied)
    padded = np.append(raw, np.zeros(8, np.uint8))
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = []
    for k in range(0, LENGTH, 8):
        # the last word overlaps the one before it, so that it ends with the window
        k = min(k, LENGTH - 8)
        words.append(np.ascontiguousarray(view[at[at_tied] + k]).view(">u8").ravel())
    keys = [bucket[row[at_tied]], *words]
    order = np.lexsort((at_tied, *reversed(keys)))
    equal = np.all([k[order[1:]] == k[order[:-1]] for k in keys], axis=0)
    again[at_tied[order[1:][equal]]] = True
    edge = np.flatnonzero(again & np.append(True, ~again[:-1] | (row[1:] != row[:-1])))
    stop = np.flatnonzero(again & np.append(~again[1:] | (row[1:] != row[:-1]), True))
    s = place[row[edge]] >> 16
    return row[edge], s + step[edge], s + step[stop] + 1


def _sorted_buckets(contexts: DataFrame) -> DataFrame:
    """id, start, end of runs of repeated windows; buckets are sorted in blocks of whole buckets."""
    kind = contexts.schema["id"].dataType.simpleString()
    dealt = contexts.repartition("bucket").sortWithinPartitions("bucket", "id", "place")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: pa.Table) -> pa.RecordBatch:
            row, start, end = repeated_windows(part.column(0).to_numpy(), part.column(2).to_numpy(), part.column(3).to_pylist())
            return pa.RecordBatch.from_arrays([part.column(1).combine_chunks().take(pa.array(row)), pa.array(start), pa.array(end)], ["id", "start", "end"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < BLOCK:
                continue
            t = pa.Table.from_batches(held)
            bucket = t.column(0).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1], "left"))  # the last bucket may go on; it has BLOCK rows at most
            if cut:
                yield done(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), len(t) - cut
        if rows:
            yield done(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, f"id {kind}, start long, end long")


def _dealt_windows(contexts: DataFrame) -> DataFrame:
    """As _sorted_buckets(), for buckets of any size: windows are dealt out one by one, by two hashes of 64 bits.

    Of equal windows of one batch only the first goes on, as in the census.
    """
    kind = contexts.schema["id"].dataType.simpleString()

    @frugal
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 10_000) for k in range(0, b.num_rows, 10_000)):
                place = part.column(2).to_numpy()
                raw, row, step, at = _windows(place, part.column(3).to_pylist())
                h1, h2 = (spans(prefix_sums(raw, i), at, at + LENGTH, i).view(np.int64) for i in (0, 1))
                start = (place[row] >> 16) + step
                first = _first_of_each(part.column(1).to_numpy(zero_copy_only=False)[row], start, h2, h1)
                # a repeat of this batch is dealt out by its place and stays a repeat
                deal = np.where(first, h1, mix((start ^ (row << 40)).view(np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(~first), pa.array(h1), pa.array(h2), part.column(1).take(pa.array(row)), pa.array(start)], ["deal", "again", "h1", "h2", "id", "start"])

    order = ("again", "h1", "h2", "id", "start")
    dealt = contexts.mapInArrow(windows, f"deal long, again boolean, h1 long, h2 long, id {kind}, start long").repartition("deal").sortWithinPartitions(*order)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if b.num_rows:
                again, h1, h2 = b.column("again").to_numpy(zero_copy_only=False), b.column("h1").to_numpy(), b.column("h2").to_numpy()
                same = np.zeros(b.num_rows, bool)
                same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
                same[0] = last == (h1[0], h2[0])
                at = np.flatnonzero(same | again)
                last = (h1[-1], h2[-1])
                start = b.column("start").to_numpy()[at]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(start), pa.array(start + 1)], ["id", "start", "end"])

    return dealt.mapInArrow(run, f"id {kind}, start long, end long")


def _compared(text: DataFrame, firsts: DataFrame) -> DataFrame:
    """id, start, end of repeated windows of the runs in firsts (bucket, id, place)."""
    hot = firsts.groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket", F.lit(True).alias("hot"))
    if hot.isEmpty():
        return _sorted_buckets(_contexts(text, firsts))
    marked = firsts.join(hot, "bucket", "left")
    small, large = (marked.where(c).select("bucket", "id", "place") for c in ("hot is null", "hot"))
    return _sorted_buckets(_contexts(text, small)).unionByName(_dealt_windows(_contexts(text, large)))


def _text_table(docs: DataFrame) -> DataFrame:
    """The texts in files by id, so that joins by id don't shuffle them."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return bucketed(docs, "id", int(min(50_000, max(4, size // BUCKET_BYTES))), "texts")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct id and row without id: id, n_bytes, n_removed, n_spans (longs), removed
    array<struct<start,end>> (byte runs), kept binary (the other bytes, one after another).

    A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in
    a smaller id or before in the same text. Null and empty texts, and texts shorter than
    that, lose nothing; long texts are taken whole. Of rows that repeat an id the smallest
    text counts. Rows with a null id are neither searched nor changed. An empty table gives
    no rows; extra columns are left out whatever their names. Ids are of any type with an
    order. Whole runs are equal if the 64-bit hashes of their bytes and of their anchors
    are; windows within unlike runs are compared byte by byte, but in buckets of more than
    BLOCK contexts by two 64-bit hashes.
    """
    tuned(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named, nameless = src.where("id is not null"), src.where("id is null")
    if not named.groupBy("id").count().where("count > 1").isEmpty():
        named = named.groupBy("id").agg(F.min("text").alias("text"))
    text = _text_table(named)
    settled = stored(_settled(_census(text)), "runs")
    compared = _compared(text, settled.where(F.col("kind") == _FIRST).select("bucket", "id", "place"))
    place = F.col("place")
    first = F.when(F.col("kind") == _RANGE, F.col("bucket")).otherwise(F.shiftright(place, 16))
    after = F.when(F.col("kind") == _RANGE, place).otherwise(F.shiftright(place, 16) + F.shiftright(place, 8).bitwiseAND(255))
    whole = settled.where(F.col("kind") != _FIRST).select("id", first.alias("start"), after.alias("end"))
    found = whole.unionByName(compared).groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    kind = src.schema["id"].dataType.simpleString()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            cols: list[list] = [[], [], []]
            starts, ends, kept = [], [], []
            for t, s, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = np.frombuffer(t.encode(), np.uint8)
                gone = np.zeros(len(raw) + 1, np.int64)
                if s:
                    np.add.at(gone, np.array(s), 1)
                    np.add.at(gone, np.array(e) + LENGTH - 1, -1)
                gone = np.cumsum(gone)[:-1] > 0
                change = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                up, down = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
                starts.append(up)
                ends.append(down)
                kept.append(raw[~gone].tobytes())
                for c, x in zip(cols, (len(raw), int(gone.sum()), len(up)), strict=True):
                    c.append(x)
            sizes = np.array([len(x) for x in starts])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols), list_column(np.concatenate(starts), sizes, pa.int64()), list_column(np.concatenate(ends), sizes, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept"])

    none = F.lit(None).cast("array<long>")
    every = text.join(found, "id", "left").select("id", "text", "starts", "ends").unionByName(nameless.select("id", "text", none.alias("starts"), none.alias("ends")))
    out = every.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary")
    pairs = F.zip_with("starts", "ends", lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", pairs.alias("removed"), "kept")


def digests(docs: DataFrame) -> DataFrame:
    return repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


