"""Operator 3: BPE encoding and decoding through a distinct-word table.

Texts are dealt into chunks of bounded size, and each chunk's distinct words are
numbered. All chunks' words meet in one order, where each distinct word is encoded once
by the library; its ids go back to the chunks by number. There each text is split once
more into its words' numbers, and ids and their pieces are put back by position, whole
arrays at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, bucketed, frugal, slices, texts, tuned
from .tokenizing import load, pre_split, tokenizer_file

#: Bytes of text in a chunk on the average, which one task holds; files that chunks are dealt into, at most.
CHUNK_BYTES, BUCKETS = 24 << 20, 50_000


@lru_cache(1)
def pieces(path: str) -> list[str]:
    """The pieces by id."""
    library = load(path)
    return [library.id_to_token(i) or "" for i in range(library.get_vocab_size(with_added_tokens=True))]


def _packing(path: str) -> str:
    """How ids are packed between steps: in two bytes where the vocabulary allows."""
    return "<u2" if len(pieces(path)) <= 1 << 16 else "<u4"


def _chunks(src: DataFrame) -> DataFrame:
    """src with chunk, in files by chunk. Rows are numbered for it, so neither ids nor texts that repeat pile up."""
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(max(2, size // CHUNK_BYTES))
    return bucketed(src.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")), "chunk", min(BUCKETS, n), "chunks")


def _distinct(column: pa.ChunkedArray) -> list[str]:
    """The sorted distinct words of all texts that needn't go to the library whole."""
    seen: set[str] = set()
    for part in column.chunks:
        for t in texts(part):
            seen.update(pre_split(t, "word") or ())
    return sorted(seen)


def _words(chunks: DataFrame) -> DataFrame:
    """chunk, n, word: the distinct words of each chunk, numbered from 0 in their order."""

    def run(own: pa.Table) -> pa.Table:
        words = _distinct(own.column("text"))
        chunk = own.column("chunk")[0].as_py()
        del own
        return pa.table({"chunk": pa.array(np.full(len(words), chunk, np.int32)), "n": pa.array(np.arange(len(words), dtype=np.int32)), "word": pa.array(words, pa.string())})

    return chunks.select("chunk", "text").groupBy("chunk").applyInArrow(run, "chunk int, n int, word string")


def _encoded(used: DataFrame, path: str) -> DataFrame:
    """chunk, n, ids binary (as _packing() says) of rows (chunk, n, word): rows of one word stand together, and the word is encoded once."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, last, last_ids, kind = load(path), None, b"", _packing(path)
        for b in batches:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(2))
            words, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            goes_on = words[0] == last
            ids = [np.array(e.ids, kind).tobytes() for e in library.encode_batch(words[1:] if goes_on else words, add_special_tokens=False)]
            ids = [last_ids, *ids] if goes_on else ids
            last, last_ids = words[-1], ids[-1]
            take = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()).take(pa.array(take))], ["chunk", "n", "ids"])

    # a word stands in each chunk once at most, so the rows of a frequent one are as many as chunks
    dealt = used.select("chunk", "n", "word").repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "chunk int, n int, ids binary")


class _Numbers(dict):
    """word -> number, in the order in which words are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@lru_cache(1)
def _piece_column(path: str) -> pa.Array:
    return pa.array(pieces(path), pa.string())


def _put_back(own: pa.Table, words: pa.Table, path: str) -> pa.Table:
    """id, n_tokens, ids, decoded of a chunk's rows (id, text), from rows (n, ids) of its words as _words() numbers them."""
    packed, numbers, split, whole = _packing(path), _Numbers(), [], []
    for batch in slices(iter(own.select(["id", "text"]).to_batches()), "text"):
        found = []
        for t in texts(batch.column(1)):
            got = pre_split(t, "word")
            if got is None:  # one entry for all of the text, counted from the end
                whole.append(np.array(load(path).encode(t, add_special_tokens=False).ids, packed))
                found.append(np.array([-len(whole)], np.int32))
            else:
                found.append(np.fromiter(map(numbers.__getitem__, got), np.int32, len(got)))
        split.append((batch.column(0), np.concatenate(found), np.cumsum([0, *map(len, found)])))
    m, order = len(numbers), sorted(numbers)
    n = words.column("n").to_numpy()
    if len(n) != m or len(np.unique(n)) != m or (m and n.max() != m - 1):
        raise ValueError(f"{len(n)} numbered words for a chunk of {m}")
    # entry of each number: words in their order, then whole texts, so that the last number finds the first of these
    entry = np.empty(m + len(whole), np.int64)
    entry[np.fromiter(map(numbers.__getitem__, order), np.int64, m)] = np.arange(m)
    entry[m:] = np.arange(m, len(entry))[::-1]
    del numbers, order
    known = [pa.concat_arrays(words.column("ids").chunks).cast(pa.large_binary())] if m else []
    ends = [np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] // np.dtype(packed).itemsize for x in known]
    flat = np.concatenate([*(np.frombuffer(x.buffers()[2], packed)[e[0] : e[-1]] if e[-1] > e[0] else np.zeros(0, packed) for x, e in zip(known, ends, strict=True)), *whole, np.zeros(0, packed)])
    lengths = np.concatenate([*(np.diff(e) for e in ends), np.array([len(x) for x in whole], np.int64)])
    starts, at = np.cumsum(lengths) - lengths, np.concatenate([n, np.arange(m, len(entry))])
    first, size = np.empty(len(entry), np.int64), np.empty(len(entry), np.int64)
    first[at], size[at] = starts, lengths
    parts = []
    for ids_of_rows, found, bounds in split:
        e = entry[found]
        upto = np.cumsum(np.concatenate([[0], size[e]]))
        ids = flat[np.repeat(first[e] - upto[:-1], size[e]) + np.arange(upto[-1])]
        ends_of_rows = upto[bounds]
        pieces_of_rows = pa.ListArray.from_arrays(pa.array(ends_of_rows.astype(np.int32)), _piece_column(path).take(pa.array(ids)))
        counts = np.diff(ends_of_rows)
        parts.append(pa.RecordBatch.from_arrays([ids_of_rows, pa.array(counts, pa.int64()), binary_column(ids.astype("<u4"), counts * 4), pc.binary_join(pieces_of_rows, " ")], ["id", "n_tokens", "ids", "decoded"]))
    return pa.Table.from_batches(parts, None if parts else pa.schema([("id", own.schema.field("id").type), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """One row per input row: id, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded string.

    Null and empty texts have 0 tokens, empty ids and text; long texts are encoded whole;
    texts with special tokens or with code points beyond Latin go to the library whole.
    Repeated rows, ties of ids and null ids are kept as they are, an empty table gives no
    rows; other columns are left out whatever their names. Texts are written once, by
    chunk, and not shuffled after that; what is shuffled are each chunk's distinct words.
    A lost task is computed again from its chunk.
    """
    path = tokenizer_file(tokenizer)
    tuned(docs.sparkSession)
    chunks = _chunks(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    known = _encoded(_words(chunks), path)

    def run(own: pa.Table, words: pa.Table) -> pa.Table:
        return _put_back(own, words, path)

    kind = docs.schema[id_col].dataType.simpleString()
    out = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Adds column decoded: the pieces of packed ids, as the library's decode gives them; null stays null, empty is empty."""
    path = tokenizer_file(tokenizer)
    tuned(encoded.sparkSession)

    @F.pandas_udf("string")
    def text(ids):
        piece = pieces(path)
        return ids.map(lambda x: None if x is None else " ".join(map(piece.__getitem__, np.frombuffer(x, "<u4").tolist())))

    return encoded.withColumn("decoded", text(F.col(ids_col)))


def digests(docs: DataFrame, **args) -> DataFrame:
    e = encode(docs, **args)
    return e.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
