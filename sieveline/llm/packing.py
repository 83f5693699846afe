"""Lexical retrieval packing: training sequences of related documents.

Every document is encoded and ends with ``end_id``. Its whole windows are sequences by themselves; the tail that is left, shorter than
a window, is packed with the tails that resemble it most. An inverted index over tokens holds all tails, in shards: tails are
sorted by their two heaviest terms, so that those about one thing lie together, and every ``SHARD`` neighbours in that order make
a shard. In a shard the first unused tail is the seed of a window; BM25 ranks the unused others against all of its terms, and
they fill the window in that order. The one that reaches its end is cut there, and its rest is the seed of the next
window. A window that is open when a shard has run out goes on with the next one of the task.

What a task has left at its end is cut at the binary digits of its length, so that it needs no padding either. Term counts and the mean
length are those of all tails. Hot terms and copies spread over tasks, since the order goes on by document. A
task holds one shard at a time; a very long document by itself while it is encoded.

Null texts are documents of the end token. Every row is a document, with a null or repeated doc_id too. Extra columns are ignored. An empty
table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import runs, texts_of
from .records import library
from .store import Scratch

#: Usual parameters of BM25.
K1, B = 1.2, 0.75
#: Tails in a shard of the index.
SHARD = 256
_WIDTH = 4
PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence long, offset long"


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids: little-endian unsigned 32-bit numbers, the last one end_id."""

    def run(batches):
        encoder = library(path)
        for b in (part for whole in batches for part in runs(whole, 1)):
            found = encoder.encode(texts_of(b.column(1)))
            sizes = found.value_lengths().to_numpy().astype(np.int64)
            ends = np.append(0, np.cumsum(sizes + 1))
            flat = np.insert(found.flatten().to_numpy(), np.cumsum(sizes), end_id).astype("<u4")
            ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends * _WIDTH).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes + 1), ids], names=["doc_id", "n_tokens", "ids"])
        encoder.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _numbers(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in column.to_pylist()]


class Postings:
    """Terms of some pieces with their counts, in the order of terms and then pieces."""

    def __init__(self, pieces: list[np.ndarray]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        n = max(1, len(pieces))
        terms = np.concatenate(pieces)
        kind = np.uint32 if len(terms) and (int(terms.max()) + 1) * n <= 1 << 32 else np.int64  # short numbers sort much faster
        both = terms.astype(kind) * kind(n) + np.repeat(np.arange(len(pieces), dtype=kind), self.sizes)
        both, self.count = np.unique(both, return_counts=True)
        self.term, self.piece = (x.astype(np.int64) for x in np.divmod(both, kind(n)))

    def weights(self, idf: np.ndarray, mean: float) -> np.ndarray:
        """BM25's weight of each term in its piece."""
        norm = K1 * (1 - B + B * self.sizes / mean)
        return idf[self.term] * self.count * (K1 + 1) / (self.count + norm[self.piece])

    def heaviest(self, weights: np.ndarray) -> list[np.ndarray]:
        """The two terms that weigh most in each piece, the lesser of equal ones first; -1: the piece has no such term."""
        order = np.argsort(self.piece.astype(np.min_scalar_type(len(self.sizes))), kind="stable")  # by piece and then term
        terms, weights = self.term[order], weights[order]
        some, counts = np.unique(self.piece[order], return_counts=True)
        first, out = np.cumsum(counts) - counts, []
        for _ in range(2):
            found = np.full(len(self.sizes), -1, np.int64)
            if len(some):
                most = np.maximum.reduceat(weights, first)
                at = np.flatnonzero(weights == np.repeat(most, counts))
                at = at[np.searchsorted(at, first)]
                left = weights[at] > -np.inf
                found[some[left]] = terms[at[left]]
                weights[at] = -np.inf
            out.append(found)
        return out


class Index:
    """A shard: an inverted index of pieces."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float):
        held = Postings(pieces)
        self.sizes, self.piece, self.weight = held.sizes, held.piece, held.weights(idf, mean)
        new = np.append(True, held.term[1:] != held.term[:-1])
        self.first = np.append(np.flatnonzero(new), len(new))
        by_piece = np.argsort(self.piece, kind="stable")
        self.terms = (np.cumsum(new) - 1)[by_piece]
        self.bounds = np.searchsorted(self.piece[by_piece], np.arange(len(pieces) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every piece for the terms of a seed."""
        terms = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        low, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.bincount(self.piece[at], self.weight[at], len(self.sizes))


class Windows:
    """Windows being filled: pieces (key, start, length, sequence, offset) in ``done`` once their sequence is full."""

    def __init__(self, window: int):
        self.window, self.room, self.sequence = window, window, 0
        self.open: list[tuple] = []
        self.done: list[tuple] = []

    def add(self, key, start: int, length: int) -> bool:
        """Put a piece where there is room. True if that ended a window; its rest, if any, then begins the next one."""
        ended = False
        while length:
            n = min(length, self.room)
            self.open.append((key, start, n, self.sequence, self.window - self.room))
            start, length, self.room = start + n, length - n, self.room - n
            if not self.room:
                self._close()
                ended = True
        return ended

    def _close(self) -> None:
        self.done += self.open
        self.open, self.room, self.sequence = [], self.window, self.sequence + 1

    def finish(self) -> None:
        """Cut what is open into sequences whose lengths are powers of two."""
        left, whole = self.open, self.window
        size = whole - self.room
        self.open, self.room = [], whole
        for bit in reversed(range(size.bit_length())):
            if size >> bit & 1:
                self.window = self.room = 1 << bit
                while self.room and left:
                    key, start, n, _, _ = left.pop(0)
                    if n > self.room:
                        left.insert(0, (key, start + self.room, n - self.room, 0, 0))
                        n = self.room
                    if self.add(key, start, n):
                        break
        self.window = self.room = whole


def fill(index: Index, keys: list, starts: list[int], out: Windows) -> Iterator[tuple[int, np.ndarray]]:
    """Pack all pieces of a shard. Yields each seed with the order in which its neighbours are asked."""
    unused, left, first, seed = np.ones(len(keys), bool), len(keys), 0, None
    while left:
        if seed is None:
            while not unused[first]:
                first += 1
            seed, unused[first], left = first, False, left - 1
            if out.add(keys[seed], starts[seed], int(index.sizes[seed])) and not out.open:
                seed = None
                continue
        scores = index.scores(seed)
        scores[~unused] = -1
        order = np.argsort(-scores, kind="stable")[:left]
        yield seed, order
        for i in order.tolist():
            unused[i], left = False, left - 1
            if out.add(keys[i], starts[i], int(index.sizes[i])):
                seed = i if out.open else None
                break


def statistics(tails: DataFrame, terms: int) -> tuple[np.ndarray, float]:
    """Inverse document frequencies by term and the mean length, over all tails (doc_id, ids).

    Each task adds up its own; what reaches the driver has a row for each term of the vocabulary at most.
    """

    def run(batches):
        seen, rows, tokens = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            if b.num_rows:
                held = Postings(_numbers(b.column(0)))
                seen += np.bincount(held.term, minlength=terms)
                rows, tokens = rows + b.num_rows, tokens + int(held.sizes.sum())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(seen[at], [rows, tokens]))], names=["term", "n"])

    found = dict(map(tuple, tails.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
    rows, tokens = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(terms)
    df[list(found)] = list(found.values())
    return np.log1p((rows - df + 0.5) / (df + 0.5)), max(1.0, tokens / max(1, rows))


def _heaviest(tails: DataFrame, idf: np.ndarray, mean: float) -> DataFrame:
    """tails with ``a`` and ``b``, the two terms that weigh most in each (-1: it has no second)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            held = Postings(_numbers(b.column(b.schema.get_field_index("ids"))))
            first, second = held.heaviest(held.weights(idf, mean))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first), pa.array(second)], names=[*b.schema.names, "a", "b"])

    return tails.mapInArrow(run, "row long, doc_id long, start long, ids binary, doc_tokens long, a long, b long")


def _packed(tails: DataFrame, idf: np.ndarray, mean: float, window: int, shard: int) -> DataFrame:
    def run(batches):
        part, out = TaskContext.get().partitionId(), Windows(window)
        held: list[dict] = []

        def batch():
            rows = [(d["doc_id"], d["start"] + s, d["ids"][s * _WIDTH : (s + n) * _WIDTH], d["doc_tokens"], part << 33 | seq, o) for d, s, n, seq, o in out.done]
            out.done = []
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

        def pack():
            for _ in fill(Index([np.frombuffer(d["ids"], "<u4") for d in held], idf, mean), held, [0] * len(held), out):
                pass
            held.clear()
            return batch()

        for b in batches:
            for row in b.to_pylist():
                held.append(row)
                if len(held) == shard:
                    yield pack()
        if held:
            yield pack()
        out.finish()
        yield batch()

    return tails.select("doc_id", "start", "ids", "doc_tokens").mapInArrow(run, PIECES)


def pack(spark: SparkSession, docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    scratch = Scratch(spark, "packing")
    coded = scratch.table(encoded(docs, path, end_id).withColumn("row", F.monotonically_increasing_id()), "ids")
    whole = F.expr(f"n_tokens div {window}")
    tail = F.substring("ids", (whole * window * _WIDTH + 1).cast("int"), F.lit((window - 1) * _WIDTH))
    tails = coded.where(f"n_tokens % {window} > 0").select("row", "doc_id", (whole * window).alias("start"), tail.alias("ids"), F.col("n_tokens").alias("doc_tokens"))
    idf, mean = statistics(tails, max(library(path).size, end_id + 1))
    keyed = scratch.table(_heaviest(tails, idf, mean), "tails")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "a", "b", "row").sortWithinPartitions("a", "b", "row")
    packed = _packed(ordered, idf, mean, window, shard).withColumn("sequence_id", F.col("sequence") * 2 + 1)
    # Whole windows: one sequence each, with even numbers.
    cut = coded.where(f"n_tokens >= {window}").select("doc_id", "n_tokens", "ids", F.explode(F.sequence(F.lit(0), whole - 1)).alias("k"))
    own = F.substring("ids", (F.col("k") * window * _WIDTH + 1).cast("int"), F.lit(window * _WIDTH))
    alone = cut.select("doc_id", (F.col("k") * window).cast("long").alias("start"), own.alias("ids"), F.col("n_tokens").alias("doc_tokens"), F.lit(0).cast("long").alias("offset"))
    alone = alone.withColumn("sequence_id", F.monotonically_increasing_id() * 2)
    out = ["doc_id", "start", (F.octet_length("ids") / _WIDTH).cast("long").alias("length"), "ids", "doc_tokens", "sequence_id", "offset"]
    return packed.select(*out).unionAll(alone.select(*out))


def report(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    pieces = pack(spark, docs, path)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
