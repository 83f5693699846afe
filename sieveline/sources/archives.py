"""Archive expansion: ZIP, tar and gzip members as input rows, nested archives included.

An archive is opened by one task, or, with ``spread``, a large one is cut into parts of consecutive members first, which go to tasks of their own. Limits and
error rows are the same either way: an archive is cut only where its members' sizes, as its directory or headers give them, fit the limit together and none
of them is an archive itself, so that no part can reach the limit. All others are opened whole.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 4
SCHEMA = "path string, identity string, content binary, error string, is_member boolean"


def kind(name: str, data: bytes) -> str | None:
    """zip, gzip, tar or None; magic numbers or the extension, in this order of precedence."""
    low = name.lower()
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06") or low.endswith(".zip"):
        return "zip"
    if data[:2] == b"\x1f\x8b" or low.endswith((".gz", ".tgz")):
        return "gzip"
    return "tar" if data[257:262] == b"ustar" or low.endswith(".tar") else None


def _bounded(stream, left: list[int]) -> bytes | None:
    """What a stream holds, or None if that is more than is left of the archive's budget."""
    data = stream.read(left[0] + 1)
    if len(data) > left[0]:
        left[0] = 0
        return None
    left[0] -= len(data)
    return data


def _inner(name: str) -> str:
    base = name.replace("\\", "/").replace("!", "/").rsplit("/", 1)[-1]
    low = base.lower()
    return base[:-4] + ".tar" if low.endswith(".tgz") else base[:-3] if low.endswith(".gz") else "content"


class Ranges(io.RawIOBase):
    """A file of which two ranges are there: bytes from ``start`` on, and its end from ``tail`` on. Between them it reads as zeros."""

    def __init__(self, data: bytes, start: int, tail: int, size: int):
        self.data, self.start, self.tail, self.size, self.at = memoryview(data), start, tail, size, 0
        self.cut = len(data) - (size - tail)  # where the end begins in data

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def readinto(self, sink) -> int:
        n = max(0, min(len(sink), self.size - self.at))
        sink[:n] = bytes(n)
        for begin, part in ((self.start, self.data[: self.cut]), (self.tail, self.data[self.cut :])):
            a, b = max(self.at, begin), min(self.at + n, begin + len(part))
            if a < b:
                sink[a - self.at : b - self.at] = part[a - begin : b - begin]
        self.at += n
        return n


def _members(form: str, name: str, data: bytes, part=None):
    """(member name, opened stream or None, error) of an archive, or of a part of it as ``parts`` gives it."""
    if form == "gzip":
        yield _inner(name), gzip.GzipFile(fileobj=io.BytesIO(data)), None
    elif form == "zip":
        first, last, *place = part or (0, None)
        with zipfile.ZipFile(Ranges(data, *place) if part else io.BytesIO(data)) as z:
            for m in z.infolist()[first:last]:
                if m.is_dir():
                    continue
                if (m.external_attr >> 16) & 0o170000 == 0o120000:
                    yield m.filename, None, "archive link is not followed"
                elif m.flag_bits & 1:
                    yield m.filename, None, "encrypted archive member is unsupported"
                else:
                    yield m.filename, z.open(m), None
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m), None
                elif m.issym() or m.islnk():
                    yield m.name, None, "archive link is not followed"
                elif not m.isdir():
                    yield m.name, None, "archive member type is unsupported"
            # The reader stops at a header it cannot read as it does at the end: only a block of zeros is the end.
            if data[t.offset : t.offset + tarfile.BLOCKSIZE] != bytes(tarfile.BLOCKSIZE):
                raise tarfile.ReadError("no end of the archive")


#: Bytes of members, packed and unpacked, from which on an archive's parts are cut.
PART = 4 << 20


def _cut(sizes: list[int], part: int) -> list[int]:
    """Where parts of consecutive members begin, and the end; each holds ``part`` bytes or a single member more than fits."""
    out, held = [0], 0
    for i, n in enumerate(sizes):
        if held and held + n > part:
            out.append(i)
            held = 0
        held += n
    return [*out, len(sizes)]


def parts(path: str, data: bytes, max_bytes: int, part: int = PART) -> list[tuple[str, bytes, tuple | None]]:
    """(form, bytes, place for ``_members``) of an archive's parts; none if it stays whole. See the module for what may be cut."""
    form = kind(path, data)
    if form not in ("zip", "tar"):
        return []
    plain = lambda name, stream: kind(f"{path}!{name}", stream.read(262)) is None  # noqa: E731  (as much as the magic numbers need)
    try:
        if form == "tar":
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
                members = t.getmembers()
                whole = not t.pax_headers and data[t.offset : t.offset + tarfile.BLOCKSIZE] == bytes(tarfile.BLOCKSIZE)
                if not whole or sum(m.size for m in members) > max_bytes or not all(plain(m.name, t.extractfile(m)) for m in members if m.isfile()):
                    return []
                edges, at = _cut([m.size for m in members], part), [*(m.offset for m in members), t.offset]
            return [(form, data[at[a] : at[b]] + bytes(2 * tarfile.BLOCKSIZE), None) for a, b in zip(edges, edges[1:], strict=False)] if len(edges) > 2 else []
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            members, tail = z.infolist(), z.start_dir
            at = [*(m.header_offset for m in members), tail]
            if sum(m.file_size for m in members) > max_bytes or at != sorted(at):
                return []
            for m in members:
                opened = not m.is_dir() and not m.flag_bits & 1
                if opened and kind(f"{path}!{m.filename}", b"") is not None:
                    return []
                try:
                    if opened and not plain(m.filename, z.open(m)):
                        return []
                except (zipfile.BadZipFile, OSError, EOFError, zlib.error, NotImplementedError):
                    pass  # an error row of that member wherever it is read
            edges = _cut([m.compress_size + m.file_size for m in members], part)
            pieces = ((a, b, at[a], at[b]) for a, b in zip(edges, edges[1:], strict=False))
            return [(form, data[i:j] + data[tail:], (a, b, i, tail, len(data))) for a, b, i, j in pieces] if len(edges) > 2 else []
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error, ValueError):
        return []


def expand_one(path: str, identity: str, data: bytes, max_bytes: int, depth: int = 0, left: list[int] | None = None, form: str | None = None, part=None):
    """Rows of SCHEMA for one input. What is no archive is passed on as it is; a bad member costs that member only. ``form`` and ``part`` are those of a part."""
    form = form or kind(path, data)
    if form is None:
        yield path, identity, data, None, depth > 0
        return
    if depth >= MAX_DEPTH:
        yield path, identity, None, "archive nesting depth limit exceeded", True
        return
    left = [max_bytes] if left is None else left
    try:
        for name, stream, error in _members(form, path, data, part):
            own, key = f"{path}!{name}", f"{identity}!{name}"
            if stream is None:
                yield own, key, None, error, True
                continue
            try:
                inner = _bounded(stream, left)
            except (zipfile.BadZipFile, OSError, EOFError, zlib.error, NotImplementedError):
                yield own, key, None, "archive member decompression or integrity check failed", True
                continue
            if inner is None:
                yield own, key, None, "archive cumulative decompressed byte limit exceeded", True
                return
            yield from expand_one(own, key, inner, max_bytes, depth + 1, left)
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error):
        yield path, identity, None, "nested archive is corrupt or unsupported" if depth else "archive is corrupt or unsupported", depth > 0


#: Bytes of members that are handed on at a time, about.
BATCH = 32 << 20


def expand(inputs: DataFrame, max_bytes: int = 64 << 20, spread: int | None = None, part: int = PART) -> DataFrame:
    """inputs (path, identity, content) with archives replaced by their members; members' errors are rows with ``error``.

    Rows that have an ``error`` already pass as they are. Other columns are repeated for each member. Members are handed on as they are
    opened, so a task holds one archive and BATCH bytes of members. With ``spread``, archives are cut into parts of about ``part`` bytes and all inputs
    dealt out over that many tasks by path and part before archives are opened; that shuffles the inputs once, packed.
    """
    import pyarrow as pa

    own = [c.split()[0] for c in SCHEMA.split(", ")]
    kept = [c for c in inputs.columns if c not in own]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.bool_()]

    def batch(rows, rest):
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, *(c.take(pa.array([0] * len(rows))) for c in rest)], names=[*own, *kept])

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 1) for i in range(whole.num_rows)):  # contents may be large: one input at a time
                path, identity, data, error, cut = (b.column(i)[0].as_py() for i in range(5))
                rest, rows, size = b.columns[5:], [], 0
                own = (cut["form"], cut["place"] and tuple(cut["place"])) if cut else (None, None)
                found = [(path, identity, None, error, False)] if error is not None else expand_one(path or "", identity or "", data or b"", max_bytes, 0, None, *own)
                for row in found:
                    rows.append(row)
                    size += len(row[2] or b"")
                    if size >= BATCH:
                        yield batch(rows, rest)
                        rows, size = [], 0
                if rows:
                    yield batch(rows, rest)

    error = F.col("error") if "error" in inputs.columns else F.lit(None).cast("string")
    extra = "".join(f", `{c}` {inputs.schema[c].dataType.simpleString()}" for c in kept)
    cuts = "struct<no: int, form: string, place: array<bigint>>"
    given = inputs.select("path", "identity", "content", error.alias("error"), F.lit(None).cast(cuts).alias("_cut"), *kept)

    def listed(batches):
        place = pa.struct([("no", pa.int32()), ("form", pa.string()), ("place", pa.list_(pa.int64()))])
        for whole in batches:
            for b in (whole.slice(i, 1) for i in range(whole.num_rows)):
                path, data, error = (b.column(i)[0].as_py() for i in (0, 2, 3))
                found = parts(path or "", data or b"", max_bytes, part) if error is None else []
                for no, (form, piece, at) in enumerate(found):
                    cut = pa.array([{"no": no, "form": form, "place": at and list(at)}], place)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([piece], pa.binary()), b.column(3), cut, *b.columns[5:]], names=b.schema.names)
                if not found:
                    yield b

    if spread:
        given = given.mapInArrow(listed, f"path string, identity string, content binary, error string, _cut {cuts}{extra}").repartition(spread, "path", "_cut.no")
    return given.mapInArrow(run, SCHEMA + extra)
