"""Operator 9: benchmark decontamination by q-gram filtering and banded alignment.

Q-gram lemma: a string within k edits of a window of W characters shares at least
W + 1 - q - k*q of its q-grams, on diagonals that differ by at most k. Shared q-grams
of an item are sorted by place in overlapping diagonal bands; wherever a stretch of W
characters reaches the bound, the windows that hold it are aligned.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, list_column, powers, slices, tuned, utf8

Q = 12
#: Windows of an item in normalised characters; one starts at each position.
WINDOW = 80
#: Edits allowed, as a share of a window.
EDIT_RATE = 0.06
#: Items with fewer normalised characters match only verbatim, as whole words; those under Q are too short to tell and never match.
MIN_CHARS = 40
#: Windows that are aligned at once.
_AT_ONCE = 512
#: Benchmark text in one index file; a larger benchmark has several, which workers map.
BLOCK_BYTES = 4 << 20
_TABLE_BITS = 22
_BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _codes() -> np.ndarray:
    """Code point to normalised one: letters in lower case, digits and marks as they are, a space for all else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major in "LMN":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalised(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal form of texts given as UTF-8, as code points: letters lower-cased, runs of anything but letters, digits and marks one space."""
    if len(raw) and int(raw.max()) >= 128:
        begins = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=begins[1:])
        offsets = begins[offsets]
        raw = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    out = _codes()[raw]
    space = out == 32
    drop = space.copy()
    drop[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    drop[first] = space[first]  # a text doesn't begin with a space
    keep = ~drop
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out[keep], total[offsets]


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


def _grams(norm: np.ndarray) -> np.ndarray:
    """Hash of the q characters from each position."""
    n = len(norm)
    if n < Q:
        return np.zeros(0, np.uint64)
    power, inverse = powers(_BASE, n)
    acc = np.empty(n + 1, np.uint64)
    acc[0] = 0
    np.cumsum((norm.astype(np.uint64) + np.uint64(1)) * power[:n], out=acc[1:])
    h = acc[Q:] - acc[:-Q]
    h *= inverse[: n + 1 - Q]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Index:
    """Q-grams of a block of items, and what a window of each may differ by; a set of arrays that a file can hold."""

    def __init__(self, items: list[tuple[int, str]]):
        ids: list[int] = []
        blobs: list[np.ndarray] = []
        bounds: list[tuple[int, int, int]] = []  # window, edits, least shared q-grams
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            blob, _ = normalised(raw, np.array([0, len(raw)]))
            if len(blob) and blob[-1] == 32:
                blob = blob[:-1]
            if len(blob) < Q:
                continue
            size = min(len(blob), WINDOW)
            k = int(EDIT_RATE * size) if size >= MIN_CHARS else 0
            need = size + 1 - Q - k * Q
            while need < 1:  # a shorter window bears fewer edits
                k -= 1
                need += Q
            ids.append(item)
            blobs.append(blob)
            bounds.append((size, k, need))
        self.items = np.array(ids, np.int64)
        self.size, self.edits, self.need = (np.ascontiguousarray(x) for x in np.array(bounds, np.int64).reshape(-1, 3).T)
        self.length = np.array([len(b) for b in blobs], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.codes = np.concatenate(blobs) if blobs else np.zeros(0, np.uint32)
        n = self.length + 1 - Q
        g = np.concatenate([_grams(b) for b in blobs]) if blobs else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(blobs)), n)
        place = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(g, kind="stable")
        self.keys, self.owner, self.place = g[order], owner[order].astype(np.int32), place[order].astype(np.int32)
        bits = np.zeros(1 << _TABLE_BITS, bool)
        bits[self.keys >> np.uint64(64 - _TABLE_BITS)] = True
        self.bits = bits

    ARRAYS = (("items", np.int64), ("size", np.int64), ("edits", np.int64), ("need", np.int64), ("length", np.int64), ("begin", np.int64), ("keys", np.uint64), ("owner", np.int32), ("place", np.int32), ("codes", np.uint32), ("bits", bool))

    def packed(self) -> bytes:
        """The arrays one after another, each padded to eight bytes, after their lengths."""
        parts = [np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.ARRAYS]
        head = np.array([len(getattr(self, name)) for name, _ in self.ARRAYS], np.int64).tobytes()
        return head + b"".join(p + bytes(-len(p) % 8) for p in parts)

    @classmethod
    def mapped(cls, data: np.ndarray) -> Index:
        self, at = cls.__new__(cls), 8 * len(cls.ARRAYS)
        for n, (name, kind) in zip(data[:at].view(np.int64).tolist(), cls.ARRAYS, strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, data[at : at + size].view(kind))
            at += size + -size % 8
        return self

    def _blob(self, o: int) -> np.ndarray:
        return self.codes[self.begin[o] : self.begin[o] + self.length[o]]

    def search(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) of texts that have a region within the edits of a window."""
        return self.search_normal(*normalised(raw, offsets))

    def search_normal(self, norm: np.ndarray, off: np.ndarray, h: np.ndarray | None = None) -> list[tuple[int, int]]:
        """search() for texts in normal form, with their q-grams if these are at hand."""
        h = _grams(norm) if h is None else h
        if not len(h) or not len(self.keys):
            return []
        at = np.flatnonzero(self.bits[h >> np.uint64(64 - _TABLE_BITS)])
        low = np.searchsorted(self.keys, h[at], "left")
        n = np.searchsorted(self.keys, h[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        doc = np.searchsorted(off, at, "right") - 1
        inside = at + Q <= off[doc + 1]
        at, low, n, doc = at[inside], low[inside], n[inside], doc[inside]
        if not len(at):
            return []
        rows = np.repeat(low, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        pos, doc = np.repeat(at, n), np.repeat(doc, n)
        own, place = self.owner[rows], self.place[rows]
        # bands of 2k+2 diagonals that overlap by half: any k+1 neighbours lie in one of them
        band = (pos - place) // (self.edits[own] + 1)
        own, band, place, doc = np.tile(own, 2), np.concatenate([band, band - 1]), np.tile(place, 2), np.tile(doc, 2)
        order = np.lexsort((place, band, own, doc))
        own, band, place, doc = (x[order] for x in (own, band, place, doc))
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (band[1:] != band[:-1]) | (doc[1:] != doc[:-1])
        group = np.cumsum(new)
        first = new.copy()
        first[1:] |= place[1:] != place[:-1]  # a q-gram of the item counts once
        own, band, place, doc, group = (x[first] for x in (own, band, place, doc, group))
        # from each q-gram on, the bound's number of them within one window
        last = np.arange(len(own)) + self.need[own] - 1
        i = np.flatnonzero(last < len(own))
        i = i[(group[last[i]] == group[i]) & (place[last[i]] - place[i] <= self.size[own[i]] - Q)]
        if not len(i):
            return []
        begin = np.maximum(0, place[last[i]] + Q - self.size[own[i]])
        end = np.minimum(place[i], self.length[own[i]] - self.size[own[i]])
        found: set[tuple[int, int]] = set()
        cuts = np.flatnonzero(np.diff(group[i])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
            d, o = int(doc[i[a]]), int(own[i[a]])
            if (d, int(self.items[o])) in found:
                continue
            wanted = np.zeros(self.length[o] + 2, np.int64)
            np.add.at(wanted, begin[a:b], 1)
            np.add.at(wanted, end[a:b] + 1, -1)
            starts = np.flatnonzero(np.cumsum(wanted) > 0)
            if self._near(o, starts, norm, int(off[d]), int(off[d + 1]), int(band[i[a]])):
                found.add((d, int(self.items[o])))
        return sorted(found)

    def _near(self, o: int, starts: np.ndarray, norm: np.ndarray, low: int, high: int, band: int) -> bool:
        """Whether a window of item o at one of starts is near a region of norm[low:high] in the band."""
        size, k, blob = int(self.size[o]), int(self.edits[o]), self._blob(o)
        left = band * (k + 1)  # the band's first diagonal
        if len(blob) < MIN_CHARS:
            item, text = _text(blob), _text(norm[low:high])
            bounds = range(max(left - low, 0), left - low + 2 * (k + 1))
            return any(text.startswith(item, x) and not _word(text[x - 1 : x]) and not _word(text[x + size : x + size + 1]) for x in bounds)
        middle = int(starts[len(starts) // 2])
        part = _text(blob[middle : middle + size])
        if part in _text(norm[max(low, left + middle) : min(high, left + 2 * (k + 1) + middle + size)]):
            return True
        return any(windows_aligned(blob, starts[x : x + _AT_ONCE], size, norm, low, high, left, 2 * (k + 1), k) for x in range(0, len(starts), _AT_ONCE))


def _word(c: str) -> bool:
    return c not in ("", " ")


def windows_aligned(item: np.ndarray, starts: np.ndarray, size: int, norm: np.ndarray, low: int, high: int, first: int, width: int, k: int) -> bool:
    """Whether a window of item at one of starts is within k edits of a substring of norm[low:high] from one of width diagonals.

    As aligned(), for all windows at once; a diagonal is a place in norm less one in item.
    """
    step = np.arange(width + 2 * k)
    diagonal = first - k + step
    big = k + 1
    at = starts[:, None] + diagonal
    row = np.where((step >= k) & (step < k + width) & (at >= low) & (at <= high), 0, big)
    for i in range(size):
        best = np.full(row.shape, big)
        inside = (at >= low) & (at < high)
        differs = norm[np.clip(at, low, high - 1)] != item[starts + i][:, None]
        best[inside] = (row + differs)[inside]
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)  # the item's character is left out
        at = at + 1
        outside = (at < low) | (at > high)
        best[outside] = big
        best = np.minimum.accumulate(best - step, axis=1) + step  # a character of norm is left out
        best[outside] = big
        row = np.minimum(best, big)
        near = row.min(1) <= k
        if not near.all():
            row, at, starts = row[near], at[near], starts[near]
            if not len(starts):
                return False
    return True


def aligned(part: bytes, region: bytes, first: int, width: int, k: int) -> bool:
    """Whether part is within k edits of some substring of region that starts at one of width diagonals from first.

    Dynamic programming over the band of these diagonals widened by k on both sides.
    """
    low, high = first - k, first + width + k  # diagonals column - row
    big = k + 1
    row = [0 if first <= low + x < first + width and 0 <= low + x <= len(region) else big for x in range(high - low)]
    for i, c in enumerate(part):
        new, left = [], big
        for x in range(high - low):
            j = i + low + x  # region index that a match at this diagonal uses
            best = row[x] + (region[j] != c) if 0 <= j < len(region) else big
            if x + 1 < high - low:
                best = min(best, row[x + 1] + 1)  # c is left out
            best = min(best, left + 1, big)
            if not 0 <= j + 1 <= len(region):
                best = big
            new.append(best)
            left = best
        row = new
        if min(row) > k:
            return False
    return min(row) <= k


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_BYTES (or one item), one at a time on the driver."""
    own, size = [], 0
    for r in benchmark.select(item_col, text_col).where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        if own and size + len(r[1]) > BLOCK_BYTES:
            yield own
            own, size = [], 0
        own.append((r[0], r[1]))
        size += len(r[1])
    yield own


def spread(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str) -> tuple[str, ...]:
    """Give every executor, also later ones, an index file per block to map; returns their names."""
    names = []
    for items in blocks(benchmark, item_col, text_col):
        data = Index(items).packed()
        name = f"benchmark-{hashlib.sha256(data).hexdigest()[:24]}.bin"
        names.append(name)
        if not os.path.exists(SparkFiles.get(name)):
            folder = tempfile.mkdtemp(prefix="pitchlake-benchmark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file as long as it runs
            with open(os.path.join(folder, name), "wb") as f:
                f.write(data)
            spark.sparkContext.addFile(os.path.join(folder, name))
    return tuple(names)


@lru_cache(2)
def _mapped(names: tuple[str, ...]) -> list[Index]:
    return [Index.mapped(np.memmap(SparkFiles.get(name), np.uint8, "r")) for name in names]


def _found(names: tuple[str, ...], raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """(row, item) over all blocks; texts are normalised once."""
    norm, off = normalised(raw, offsets)
    h = _grams(norm)
    return [x for index in _mapped(names) for x in index.search_normal(norm, off, h)]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """One row per input row: id, contaminated boolean, n_items long, items array<long> (ascending).

    A document matches an item if a window of the item's normal form (WINDOW characters
    from any position, or the whole item if shorter) is within EDIT_RATE edits of one of
    its regions. Items under MIN_CHARS match only verbatim, between word ends. Null and
    empty texts match nothing; long ones are searched whole; null items and those under Q
    characters are matched by nothing, an empty benchmark by no text, and an empty table
    of documents gives no rows. Repeated items and items of one text all count; an id in
    items stands once. Repeated rows, ties of ids and null ids stay; extra columns are
    left out whatever their names. Nothing is shuffled. Item ids are integers. Executors
    map the index files, so a large benchmark takes disk and passes in memory, not heap.
    """
    spark = tuned(docs.sparkSession)
    names = spread(spark, benchmark, item_col, bench_text)
    kind = docs.schema[id_col].dataType.simpleString()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 19):
            items: list[set[int]] = [set() for _ in range(b.num_rows)]
            for row, item in _found(names, *utf8(b.column(1))):
                items[row].add(item)
            n = np.array([len(x) for x in items])
            flat = np.array([i for own in items for i in sorted(own)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n > 0), pa.array(n, pa.int64()), list_column(flat, n, pa.int64())], ["id", "contaminated", "n_items", "items"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {kind}, contaminated boolean, n_items long, items array<long>").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """The rows of docs that match no item, with all their columns.

    As matches(): null and empty texts and rows of any id stay, repeated rows are judged
    alike, long texts whole; an empty benchmark removes nothing, an empty table stays empty.
    """
    spark = tuned(docs.sparkSession)
    names = spread(spark, benchmark, item_col, bench_text)

    @F.pandas_udf("boolean")
    def clean(text):
        import pandas as pd

        good = np.ones(len(text), bool)
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), pa.array(text, pa.string(), from_pandas=True)], ["i", "t"])
        for b in slices(iter([batch]), "t", 1 << 19):
            first = b.column(0)[0].as_py()
            for row, _ in _found(names, *utf8(b.column(1))):
                good[first + row] = False
        return pd.Series(good)

    return docs.where(clean(F.col(text_col).cast("string")))
