"""Byte-level BPE from a tokenizer file: encoding and decoding as DataFrame steps.

Encoding merges the symbols of one pre-token with a priority queue of merge ranks over a doubly linked list;
entries whose symbols have changed since they were queued are stale and skipped. Decoding concatenates
vocabulary strings. A document's pre-tokens are independent of each other, so each Python worker keeps a bounded
cache of the pre-tokens it has met in a task; the cache only saves time, never changes a result.

Null texts count as empty (no ids, empty decoded text); repeated rows are each encoded; an empty table gives an empty one.
Texts go through in runs of up to ``RUN_CHARS`` characters, and a longer text by itself, so memory follows the longest
text. Extra columns are kept; a column that has the name of one to be added is refused with ValueError.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import staying

#: White space as Unicode defines it; the tokenizer's pattern means exactly these characters by \s.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level pre-tokenizer's pattern (fixed by the public tokenizer format).
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Stands where a text is cut; texts that hold it are not cut.
_MARK = "\0"
#: A space between two other white-space characters: there, cutting at spaces is not enough.
_ODD = re.compile(r"\s \s").search
#: A line's end beside other white space: there, cutting at lines is not enough.
_RAGGED = re.compile(r"\n(?:(?<=\s\n)|(?=\s))").search
#: Pre-tokens a worker remembers, and the longest one worth remembering (characters).
CACHE_WORDS, CACHE_CHARS = 250_000, 48
#: Rows and characters of texts that are worked on at a time, about.
RUN_ROWS, RUN_CHARS = 4000, 1 << 23
#: Characters of a run where other stages follow in the same workers, which keep what their largest run took. It costs some more CPU.
FEW_CHARS = 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in kept}
    out.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)})
    return out


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Apply merges to the ids of single bytes: lowest rank first, leftmost first among equals.

    ranks: (left << 20 | right) -> rank; made: rank -> id of the merged symbol.
    """
    n = len(symbols)
    if n == 1:
        return symbols
    sym, get = symbols, ranks.get
    # A queue entry is one number, the rank above the position, so that entries compare fast.
    queue = [r << 32 | i for i in range(n - 1) if (r := get(sym[i] << 20 | sym[i + 1])) is not None]
    if not queue:
        return sym
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heapq.heapify(queue)
    pop, push = heapq.heappop, heapq.heappush
    while queue:
        top = pop(queue)
        i, rank = top & 0xFFFFFFFF, top >> 32
        left, j = sym[i], after[i]
        if left < 0 or j >= n or get(left << 20 | sym[j]) != rank:
            continue  # stale: one of the two symbols has been merged away since
        new = sym[i] = made[rank]
        sym[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := get(new << 20 | sym[k])) is not None:
                push(queue, r << 32 | i)
        if (h := before[i]) >= 0 and (r := get(sym[h] << 20 | new)) is not None:
            push(queue, r << 32 | h)
    return [s for s in sym if s >= 0]


def cuttable(text: str) -> bool:
    """Whether cutting before every space cuts only where the pre-tokenizer does."""
    return not (not text or "  " in text or text[-1] == " " or _ODD(text))


def cut(text: str) -> str | None:
    """The text with marks where its pre-tokens part for certain: before spaces, and at both sides of a line's end. None if marks won't do."""
    if _MARK in text or not cuttable(text):
        return None
    marked = text.replace(" ", f"{_MARK} ")
    return marked if "\n" not in text or _RAGGED(text) else marked.replace("\n", f"{_MARK}\n{_MARK}")


def encode_texts(texts: list[str], special: Iterable[str], by_piece: Callable[[pa.Array], pa.Array], by_text: Callable[[list[str]], list[bytes]]) -> pa.ListArray:
    """Ids of texts. Texts are cut, and each distinct piece of a call is asked for once; what can't be cut is asked for whole.

    Texts with special tokens in them are not cut. by_piece takes a column of pieces and gives a column of lists, by_text gives ids as little-endian
    int32 bytes.
    """
    marked = [None if any(s in x for s in special) else cut(x) for x in texts]
    pieces = pc.split_pattern(pa.array([x for x in marked if x is not None], pa.large_string()), _MARK)
    coded = pieces.flatten().dictionary_encode()
    known = by_piece(coded.dictionary)
    at = coded.indices.to_numpy(zero_copy_only=False)
    sizes = known.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(sizes[at], dtype=np.int64))[pieces.offsets.to_numpy()]
    found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), known.take(coded.indices).flatten())
    if len(found) == len(texts):
        return found
    whole = [i for i, x in enumerate(marked) if x is None]
    order = np.empty(len(texts), np.int64)
    order[[i for i, x in enumerate(marked) if x is not None]] = np.arange(len(found))
    order[whole] = np.arange(len(found), len(texts))
    return pa.concat_arrays([found, list_column(by_text([texts[i] for i in whole]))]).take(pa.array(order))


class Remembered(dict):
    """Values by key, of which the last CACHE_WORDS looked up at least are remembered, and twice as many at most."""

    def __init__(self):
        self.older: dict = {}

    def trim(self) -> None:
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()

    def forget(self) -> None:
        self.older = {}
        self.clear()


class _Pieces(Remembered):
    """Ids of pieces of text as little-endian int32 bytes, by piece."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            bpe, words = self.bpe, self.bpe.find(piece)
            if len(words) == 1:
                byte_id = bpe.byte_id
                ids = array("i", merge([byte_id[b] for b in piece.encode()], bpe.ranks, bpe.made)).tobytes()
            else:
                ids = b"".join(map(self.__getitem__, words))
        if len(piece) <= CACHE_CHARS:
            self.trim()
            self[piece] = ids
        return ids


class Bpe:
    """A tokenizer file in memory."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are read")
        vocab, letters = model["vocab"], byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [vocab[a + b] for a, b in pairs]
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        values = {c: b for b, c in letters.items()}
        strings = {i: bytes(values[c] for c in s) for s, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings |= {i: s.encode() for s, i in special.items()}
        self.size = max(strings) + 1
        self.strings = pa.array([strings.get(i) for i in range(self.size)], pa.large_binary())
        self.special = {s: np.int32(i).tobytes() for s, i in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.find = regex.compile(_PATTERN).findall
        self.pieces = _Pieces(self)

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of texts; special tokens' strings in them become their ids."""
        return encode_texts(texts, self.special, lambda pieces: list_column([self.pieces[x] for x in pieces.to_pylist()]), lambda rest: [self._whole(x) for x in rest])

    def _whole(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[x] if x in self.special else self._plain(x) for x in self.cut.split(text))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: pa.ListArray) -> pa.LargeStringArray:
        """The texts of lists of ids (null: empty): vocabulary strings put together, broken UTF-8 replaced."""
        ids = ids.fill_null([]) if ids.null_count else ids
        held = self.strings.take(ids.flatten())
        if held.null_count:
            raise ValueError("an id that the vocabulary does not have")
        bounds = np.frombuffer(held.buffers()[1], np.int64) if len(held) else np.zeros(1, np.int64)
        data = held.buffers()[2] or pa.py_buffer(b"")
        ends = bounds[np.append(0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), data])
        try:
            return out.cast(pa.large_string())  # checks the UTF-8 of each text
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.large_string())

    def forget(self) -> None:
        """Free the caches."""
        self.pieces.forget()


_loaded: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    """The tokenizer at path, loaded once in each Python process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def list_column(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int64)
    if ends[-1] > 2**31 - 1:
        raise ValueError("too many ids in one batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def lists_of(ids: pa.LargeBinaryArray) -> pa.ListArray:
    """list_column of a column of bytes without nulls."""
    bounds = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    if bounds[-1] - bounds[0] > 4 * (2**31 - 1):
        raise ValueError("too many ids in one batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    flat = np.frombuffer(ids.buffers()[2] or b"", np.int32)[bounds[0] // 4 : bounds[-1] // 4]
    return pa.ListArray.from_arrays(pa.array(((bounds - bounds[0]) // 4).astype(np.int32)), pa.array(flat))


def runs(batch: pa.RecordBatch, column: int, chars: int = RUN_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of up to RUN_ROWS rows and about ``chars`` characters of a text column; a longer text is a run by itself."""
    if not batch.num_rows:
        return
    until = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < batch.num_rows:
        before = until[row - 1] if row else 0
        end = min(row + RUN_ROWS, max(row + 1, int(np.searchsorted(until, before + chars, "right"))))
        yield batch.slice(row, end - row)
        row = end


def texts_of(column: pa.Array) -> list[str]:
    """A text column's values; null is empty."""
    return [x or "" for x in column.to_pylist()]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of its texts in a column ``ids`` (array<int>), which takes the place of ``text``."""
    kept = staying(docs, (ids,), (text,))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        bpe = tokenizer(path)
        for b in (part for whole in batches for part in runs(whole, len(kept))):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], bpe.encode(texts_of(b.column(len(kept))))], names=[*kept, ids])
        bpe.forget()

    return _plain_columns(docs, kept, text).mapInArrow(run, schema)


def _plain_columns(docs: DataFrame, kept: list[str], text: str) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{text}`").cast("string").alias("text"))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a column ``decoded``: the concatenated vocabulary strings of its ids (null ids: empty)."""
    kept = staying(docs, (out,))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out, T.StringType(), False)])
    at = kept.index(ids)

    def run(batches):
        bpe = tokenizer(path)
        for whole in batches:
            for b in (whole.slice(i, RUN_ROWS) for i in range(0, whole.num_rows, RUN_ROWS)):
                yield pa.RecordBatch.from_arrays([*b.columns, bpe.decode(b.column(at)).cast(pa.string())], names=[*kept, out])

    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept))).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded", chars: int = RUN_CHARS) -> DataFrame:
    """encode and then decode, in one pass through one worker: docs with ``ids`` and ``decoded`` in place of ``text``. ``chars``: as in ``runs``."""
    kept = staying(docs, (ids, out), (text,))
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(out, T.StringType(), False)]
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def run(batches):
        bpe = tokenizer(path)
        for b in (part for whole in batches for part in runs(whole, len(kept), chars)):
            found = bpe.encode(texts_of(b.column(len(kept))))
            columns = [*b.columns[: len(kept)], found, bpe.decode(found).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, out])
        bpe.forget()

    return _plain_columns(docs, kept, text).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: token count and digests of its ids and of the text decoded from them."""
    return round_trip(docs.select("doc_id", "text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
