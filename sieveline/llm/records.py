"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of frames, one per document in ascending doc_id order:

    length of the payload    unsigned 64-bit, little-endian
    masked CRC of the length unsigned 32-bit
    payload                  doc_id (signed 64-bit), number of ids (unsigned 64-bit), ids
    masked CRC of the payload unsigned 32-bit

Ids take 2 bytes each while the vocabulary has at most 65,536 entries, else 4. The CRC is CRC-32 (zlib), masked by
a rotation and a constant so that a CRC over data which holds CRCs stays sound. The index of a data file is one
row of four signed 64-bit numbers per record: doc_id, byte offset of the frame, bytes of the frame, ids before it in
this file. Readers that shuffle need only the index and then read single frames.

Null texts are empty documents (only the end id). Equal doc_ids stay together, ordered by text; a null doc_id sorts
first and is stored as the smallest 64-bit number. Extra columns are ignored. An empty table gives no records. Texts are encoded in
runs of bounded size, a very long text by itself, so memory follows the longest text.

Each attempt of a task writes under a name of its own, and the manifest, which only finished attempts reach, names the
files that count: a lost or repeated attempt leaves files behind that nothing reads.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CACHE_CHARS, CACHE_WORDS, byte_letters, encode_texts, list_column, lists_of, runs, texts_of
from .repeats import RANGE_CHARS
from .store import Scratch

_NULL_ID = -(2**63)
#: A piece of two pre-tokens is a word of letters that all versions of Unicode know, with marks behind it or none (never an apostrophe, which may
#: go with letters).
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and (c.isascii() or c >= "\xc0"))
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")
_WORD = "^ ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+$"


def _strings(column: pa.Array) -> list[str]:
    """to_pylist of a column without nulls, several times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Met:
    """Words with their ids as little-endian int32 bytes, of which the last CACHE_WORDS added at least are remembered, and twice as many at most.

    Both are Arrow columns, so that a run's words are looked up all at once and take little memory.
    """

    def __init__(self):
        self.forget()

    def __iter__(self) -> Iterator[str]:
        return iter(_strings(self.words))

    def find(self, words: pa.Array, make: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """Ids of distinct words; ``make`` gives those of words that are not remembered."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = words.filter(pa.array(at < 0))
        at[at < 0] = np.arange(len(self.words), len(self.words) + len(new))
        held, ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, make(new)])
        found = ids.take(pa.array(at))
        first = len(held) - CACHE_WORDS if len(held) > 2 * CACHE_WORDS else 0
        self.words, self.ids = held.slice(first), ids.slice(first)
        return found

    def forget(self) -> None:
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())


class LibraryEncoder:
    """Texts to ids by the tokenizers library.

    The library is slow on whole texts of few distinct words, so texts are cut where its pre-tokenizer always cuts too,
    and each distinct piece goes through it once. Most pieces are a word, with marks behind it or not: these are the library's own
    pre-tokens (by ``_WORD``), so word and marks go through the library's model directly, each distinct one once, and those already
    met are remembered up to a bound. Texts where such cuts are not enough, and those with special tokens in them, go through it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known = Met()
        spec = json.loads(self.library.to_str())
        pre = spec["pre_tokenizer"] or {}
        # Only what the byte-level pre-tokenizer leaves as it is can be given to the model.
        plain = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and not spec["normalizer"]
        self.model = self.library.model if plain and not spec["model"].get("dropout") else None
        letters = byte_letters()
        self.letters = "\0" + "".join(letters[b] for b in range(1, 256))
        self.size = self.library.get_vocab_size(with_added_tokens=True)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of single pre-tokens of the library, by its model."""
        tokenize = self.model.tokenize
        mapped = "\0".join(_strings(words)).encode().decode("latin-1").translate(self.letters).split("\0") if len(words) else []
        ids, ends = array("i"), array("q", [0])
        for word in mapped:
            ids.extend([t.id for t in tokenize(word)])
            ends.append(4 * len(ids))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(mapped), [None, pa.py_buffer(ends), pa.py_buffer(ids)])

    def _by_piece(self, pieces: pa.Array) -> pa.Array:
        if self.model is None:
            return list_column(self._whole(pieces.to_pylist()))
        word = pc.utf8_rtrim(pieces, _MARKS)
        plain = pc.and_(pc.match_substring_regex(word, _WORD), pc.less_equal(pc.binary_length(pieces), CACHE_CHARS))
        marks = pc.utf8_ltrim(pieces.filter(plain), " " + _LETTERS)
        # Words and marks apart, so that a word is asked for once, whatever marks are behind it.
        coded = pa.concat_arrays([word.filter(plain), marks]).dictionary_encode()
        ids = self.known.find(coded.dictionary, self._words).take(coded.indices)
        both = pc.binary_join_element_wise(ids.slice(0, len(marks)), ids.slice(len(marks)), pa.scalar(b"", pa.large_binary()))
        if len(both) < len(pieces):
            rest = pa.array(self._whole(pieces.filter(pc.invert(plain)).to_pylist()), pa.large_binary())
            both = pc.replace_with_mask(pa.nulls(len(pieces), pa.large_binary()), plain, both)
            both = pc.replace_with_mask(both, pc.invert(plain), rest)
        return lists_of(both)

    def encode(self, texts: list[str]) -> pa.ListArray:
        return encode_texts(texts, self.special, self._by_piece, self._whole)

    def forget(self) -> None:
        """Free the cache."""
        self.known.forget()


_loaded: dict[str, LibraryEncoder] = {}


def library(path: str) -> LibraryEncoder:
    """The encoder at path, loaded once in each Python process; its own threads are off, since tasks fill the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = LibraryEncoder(path)
    return _loaded[path]


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: memoryview, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and where the next one starts; ValueError if a checksum differs."""
    head = bytes(data[at : at + 8])
    (n,) = struct.unpack("<Q", head)
    if struct.unpack_from("<I", data, at + 8)[0] != masked_crc(head):
        raise ValueError(f"damaged length at byte {at}")
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) != n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked_crc(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + n


def write(docs: DataFrame, path: str, folder: str, end_id: int, parts: int, wide: bool = False) -> DataFrame:
    """Write docs (doc_id, text) under the URI ``folder``. One row per file: part, name, n_docs, n_tokens."""
    kind = np.dtype("<u4") if wide else np.dtype("<u2")

    def run(batches):
        encoder, part = library(path), TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"tokens-{part:06d}-{uuid.uuid4().hex[:8]}"
        rows, at, n, last = [], 0, 0, np.array(end_id, kind).tobytes()
        with store.open_output_stream(f"{base}/{name}.records") as out:
            for b in (part for whole in batches for part in runs(whole, 1)):
                found = encoder.encode(texts_of(b.column(1)))
                flat, ends = found.flatten().to_numpy().astype(kind), np.append(0, np.cumsum(found.value_lengths().to_numpy()))
                for doc_id, i, j in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    key = _NULL_ID if doc_id is None else doc_id
                    data = frame(struct.pack("<qQ", key, j - i + 1) + flat[i:j].tobytes() + last)
                    out.write(data)
                    rows.append((key, at, len(data), n))
                    at, n = at + len(data), n + j - i + 1
        encoder.forget()
        with store.open_output_stream(f"{base}/{name}.index") as out:
            out.write(np.array(rows, "<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([n], pa.int64())], names=["part", "name", "n_docs", "n_tokens"])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # Ranges by the text's beginning too, so that the rows of one doc_id, or of none, are parted; the order is that of doc_id and text.
    ordered = own.repartitionByRange(parts, "doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "part long, name string, n_docs long, n_tokens long")


def read(files: DataFrame, folder: str, wide: bool = False, block: int = 8 << 20) -> DataFrame:
    """Read files (name, base: ids before the file) back: doc_id, start, n_tokens, ids_crc32, one row per record."""
    kind = np.dtype("<u4") if wide else np.dtype("<u2")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}.index") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 4)
                with store.open_input_file(f"{root}/{name}.records") as f:
                    first = 0
                    while first < len(index):
                        last = max(first + 1, int(np.searchsorted(index[:, 1] + index[:, 2], index[first, 1] + block, "right")))
                        f.seek(int(index[first, 1]))
                        data = memoryview(f.read(int(index[last - 1, 1] + index[last - 1, 2] - index[first, 1])))
                        rows = []
                        for key, at, _, before in index[first:last].tolist():
                            payload, _ = unframe(data, at - int(index[first, 1]))
                            own, n = struct.unpack_from("<qQ", payload)
                            if own != key:
                                raise ValueError(f"the index of {name} names another document at byte {at}")
                            ids = np.frombuffer(payload, kind, n, 16)
                            rows.append((None if key == _NULL_ID else key, base + before, n, zlib.crc32(ids.astype("<u4").tobytes())))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                        first = last

    return files.select("name", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Write docs in doc_id order to a shared folder and read every record back with its global start."""
    scratch = Scratch(spark, "token-records")
    folder = scratch.path("files")
    wide = max(library(path).size, end_id + 1) > 1 << 16
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = scratch.table(write(docs, path, folder, end_id, parts, wide), "manifest")
    # The manifest has one row per file, as many as ``parts``; its prefix sum is taken on the driver.
    rows = sorted(manifest.collect(), key=lambda r: r["part"])
    bases, before = [], 0
    for r in rows:
        if r["n_docs"]:
            bases.append((r["name"], before))
        before += r["n_tokens"]
    files = spark.createDataFrame(bases, "name string, base long").repartition(max(1, len(bases)), "name")
    return read(files, folder, wide)
