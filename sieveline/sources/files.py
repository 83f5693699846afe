"""File trees as inputs.

The driver walks folders and keeps those, with the ignore rules in force in each; tasks list the files of their folders, apply the rules to
them and open them by their literal names, so no name is taken for a pattern. A file or folder that cannot be read is an error row.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import pickle
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROW = "path string, identity string, content binary, length bigint, error string"
#: Files that a task lists, about, and bytes that it hands on at a time.
SHARE, BATCH = 512, 8 << 20


def _glob(body: str, anchored: bool) -> re.Pattern:
    """An ignore pattern as a regular expression over the path below the pattern's folder; ValueError if it is none."""
    out, at = [] if anchored else ["(?:.*/)?"], 0
    while at < len(body):
        if body.startswith("**/", at) and (at == 0 or body[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
        elif body.startswith("/**", at) and at + 3 == len(body):
            out.append("/.+")
            at += 3
        elif body[at] == "[":
            end = body.find("]", at + 2 + (body[at + 1 : at + 2] in ("!", "^")))
            if end < 0:
                raise ValueError("an unclosed class")
            inner = body[at + 1 : end]
            refused = inner[0] in "!^"
            out.append(f"(?!/)[{'^' * refused}" + re.sub(r"([\\\[\]&~|^])", r"\\\1", inner[refused:]) + "]")
            at = end + 1
        elif body[at] == "\\" and at + 1 < len(body):
            out.append(re.escape(body[at + 1]))
            at += 2
        else:
            run = len(body[at:]) - len(body[at:].lstrip("*"))
            out.append("[^/]*" if run else "[^/]" if body[at] == "?" else re.escape(body[at]))
            at += max(run, 1)
    try:
        return re.compile("".join(out), re.DOTALL)
    except re.error:
        raise ValueError("an invalid class") from None


class _Patterns:
    """The lines of one ignore file, applied to what lies below a folder."""

    def __init__(self, folder: Path, file: Path, errors: list[tuple[str, str]], seen: list[bytes] | None = None):
        """seen: gets the name and the bytes of a file that is there."""
        self.folder, self.lines = folder, []
        try:
            held = file.read_bytes() if file.is_file() else None
            text = (held or b"").decode(errors="replace")
            if held is not None and seen is not None:
                seen += [os.fsencode(file), held]
        except OSError:
            errors.append((str(file), "ignore policy could not be read"))
            return
        for line in text.split("\n"):
            line = re.sub(r"(?<!\\)[ \t\r]+\Z", "", line)
            if not line or line.startswith("#"):
                continue
            negated, body = line.startswith("!"), line.removeprefix("!")
            bare = body.rstrip("/")
            try:
                self.lines.append((_glob(bare.removeprefix("/"), "/" in bare), negated, body.endswith("/")))
            except ValueError:
                errors.append((str(file), "ignore policy holds an invalid pattern"))

    def verdict(self, path: Path, folder: bool) -> bool | None:
        """Whether the path is ignored, or None if no line speaks of it; the last one that does counts."""
        inside = path.relative_to(self.folder).as_posix() if self.lines else ""
        return next((not negated for glob, negated, folders in reversed(self.lines) if (folder or not folders) and glob.fullmatch(inside)), None)


def _exclude_file(folder: Path) -> Path:
    """info/exclude of a folder's repository, also of that which a linked working tree belongs to."""
    git = folder / ".git"
    if git.is_file():
        own = folder / git.read_text(errors="replace").partition("gitdir:")[2].strip()
        common = own / "commondir"
        git = own / common.read_text(errors="replace").strip() if common.is_file() else own
    return git / "info" / "exclude"


def _global_file() -> Path:
    """The user's ignore file for all repositories, as Git names it or at Git's default place."""
    try:
        named = subprocess.run(["git", "config", "--global", "--type=path", "core.excludesFile"], capture_output=True, text=True).stdout.strip()
    except OSError:
        named = ""
    return Path(named) if named else Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "git" / "ignore"


class _Policy:
    """Ignore files in force in a folder. .ignore speaks before .gitignore, then info/exclude, then the user's file; inner folders before outer ones."""

    def __init__(self, plain=(), git=(), exclude=(), user=()):
        self.kinds = (plain, git, exclude, user)

    def inside(self, folder: Path, errors: list[tuple[str, str]], seen: list[bytes]) -> _Policy:
        plain, git, exclude, user = self.kinds

        def own(file: Path) -> tuple[_Patterns, ...]:
            patterns = _Patterns(folder, file, errors, seen)
            return (patterns,) if patterns.lines else ()

        if (folder / ".git").exists():  # a repository of its own
            seen += [b"border", os.fsencode(folder)]
            git, exclude = (), own(_exclude_file(folder))
        return _Policy((*own(folder / ".ignore"), *plain), (*own(folder / ".gitignore"), *git), exclude, user)

    def ignores(self, path: Path, folder: bool) -> bool:
        said = (p.verdict(path, folder) for kind in self.kinds for p in kind)
        return next((v for v in said if v is not None), False)


def _name(path: str | Path) -> str:
    """A path as text; bytes of it that are no UTF-8 are replaced."""
    return os.fsencode(path).decode(errors="replace")


@dataclass
class Survey:
    """What the driver knows of file trees: folders (folder, root, ignore rules in it, number of entries), files named as roots, errors, and
    all that shaped the choice, in order, for the scan's context."""

    roots: list[str] = field(default_factory=list)
    folders: list[tuple[Path, Path, _Policy | None, int]] = field(default_factory=list)
    files: list[Path] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)
    policy: list[bytes] = field(default_factory=list)

    def name(self) -> str:
        """Tells one part of a survey from another: a digest of the folders, with how many entries they had, files and errors that it covers."""
        covered = [[(os.fspath(f), os.fspath(top), n) for f, top, _, n in self.folders], [os.fspath(f) for f in self.files], self.errors]
        return hashlib.sha256(json.dumps(covered).encode("utf-8", "surrogateescape")).hexdigest()[:16]


def _entries(folder: Path, policy: _Policy | None) -> Iterator[os.DirEntry]:
    """A folder's files and folders that count; links and .git are not entered."""
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        if not (entry.is_symlink() or entry.name == ".git" or (policy and policy.ignores(Path(entry.path), entry.is_dir()))):
            yield entry


def survey(roots: list[str], respect_ignore: bool = True) -> Survey:
    """Walk the folders below the roots. Display paths are relative to the outermost root; files of nested roots count once. Hidden files are
    included. Ignore files, also those of the folders above a root, prune before anything is read. A .gitignore counts outside of repositories too,
    but not across a repository's border.
    """
    real = sorted({Path(r).resolve() for r in roots if Path(r).exists()})
    out = Survey([_name(r) for r in real])
    out.errors += [(_name(r), "input path does not exist") for r in roots if not Path(r).exists()]
    out.policy.append(b"ignore files count" if respect_ignore else b"ignore files do not count")
    for top in (r for r in real if not any(o in r.parents for o in real)):
        if top.is_file():
            out.files.append(top)
            continue
        policy = None
        if respect_ignore:
            policy = _Policy(user=(_Patterns(top, _global_file(), out.errors, out.policy),))
            for above in reversed(top.parents):
                policy = policy.inside(above, out.errors, out.policy)
        left = [(top, policy)]
        while left:
            folder, policy = left.pop()
            policy = policy and policy.inside(folder, out.errors, out.policy)
            try:
                inner, n = [], 0
                for entry in _entries(folder, policy):
                    n += 1
                    if entry.is_dir():
                        inner.append((Path(entry.path), policy))
            except OSError:
                out.errors.append((_name(folder), "directory traversal failed"))
                continue
            out.folders.append((folder, top, policy, n))
            left += reversed(inner)
    return out


def _files(folder: Path, root: Path, policy: _Policy | None) -> list[tuple[str, str]]:
    """(display, path) of a folder's own files."""
    return [(Path(e.path).relative_to(root).as_posix(), e.path) for e in _entries(folder, policy) if e.is_file()]


def listing(roots: list[str], respect_ignore: bool = True) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(display, path) of the files below the roots, and (path, message) of roots that are missing and ignore files with faults. For small trees."""
    known = survey(roots, respect_ignore)
    found = [(_name(p.parent), p.name, str(p)) for p in known.files] + [(_name(root), d, p) for folder, root, policy, _ in known.folders for d, p in _files(folder, root, policy)]
    return [(d, p) for _, d, p in sorted(found)], known.errors


class Share(InputPartition):
    """What one task lists and reads: (folder, root, ignore rules, nth, of) - every of-th file from the nth on - and single files."""

    def __init__(self, folders: list[tuple], files: list[Path], errors: list[tuple[str, str]]):
        self.folders, self.files, self.errors = folders, files, errors


class FileTree(DataSource):
    """Files of a survey as rows of ROW. Options: ``survey`` (pickled, in Base64), ``max_bytes``, ``longest``."""

    @classmethod
    def name(cls) -> str:
        return "sieveline_files"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> FileReader:
        longest = self.options.get("longest")
        return FileReader(pickle.loads(base64.b64decode(self.options["survey"])), int(self.options["max_bytes"]), None if longest is None else int(longest))


class FileReader(DataSourceReader):
    """``longest``: files beyond it are passed over unread. It is an option and no pushed-down filter: Spark 4.1 keeps a filter that one query
    has pushed into a Python source for every other query over the same DataFrame, which then lose rows."""

    def __init__(self, known: Survey, max_bytes: int, longest: int | None = None):
        self.known, self.max_bytes, self.longest = known, max_bytes, longest

    def partitions(self) -> list[Share]:
        """Folders of few files share a task; a folder of many is split over several."""
        out, held, n = [Share([], self.known.files, self.known.errors)], [], 0
        for folder, root, policy, entries in self.known.folders:
            of = max(1, -(-entries // SHARE))
            for nth in range(of):
                held.append((folder, root, policy, nth, of))
                n += -(-entries // of) + 1
                if n >= SHARE:
                    out.append(Share(held, [], []))
                    held, n = [], 0
        return [*out, Share(held, [], [])] if held else out

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self._rows(share):
            if self.longest is not None and row[3] is not None and row[3] > self.longest:
                continue
            rows.append(row)
            size += 200 + len(row[2] or b"")
            if size >= BATCH:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, share: Share) -> Iterator[tuple]:
        yield from ((path, path, None, None, message) for path, message in share.errors)
        yield from (self._file(p.name, str(p)) for p in share.files)
        for folder, root, policy, nth, of in share.folders:
            try:
                found = _files(folder, root, policy)
            except OSError:
                yield _name(folder), _name(folder), None, None, "directory traversal failed"
                continue
            yield from (self._file(*f) for f in found[nth::of])

    def _file(self, display: str, path: str) -> tuple:
        """A row; what is too long is not read, and of a file that grows no more than the limit."""
        name, identity = _name(display), _name(path)
        over = f"input exceeds {self.max_bytes} byte limit"
        try:
            with open(path, "rb") as f:
                length = os.fstat(f.fileno()).st_size
                if length > self.max_bytes:
                    return name, identity, None, length, over
                if self.longest is not None and length > self.longest:
                    return name, identity, None, length, None
                data = f.read(self.max_bytes + 1)
        except OSError as e:
            return name, identity, None, None, f"input could not be read ({type(e).__name__})"
        return (name, identity, None, len(data), over) if len(data) > self.max_bytes else (name, identity, data, len(data), None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ROW.split(", ")])


def units(known: Survey, folders: int = 256) -> list[Survey]:
    """A survey in parts of so many folders, for scans that commit part by part."""
    cut = [known.folders[i : i + folders] for i in range(0, len(known.folders), folders)] or [[]]
    first = [Survey(known.roots, cut[0], known.files, known.errors, known.policy)]
    return first + [Survey(known.roots, part, [], [], known.policy) for part in cut[1:]]


def rows(spark: SparkSession, known: Survey, max_bytes: int = 64 << 20, longest: int | None = None) -> DataFrame:
    """One row (path, identity, content, length, error) for each file and each error of a survey; all in one pass over the files.

    Files over ``max_bytes`` are error rows; those over ``longest``, if given, are left out without being read.
    """
    spark.dataSource.register(FileTree)
    held = base64.b64encode(pickle.dumps(known)).decode()
    limits = {"max_bytes": max_bytes} | ({} if longest is None else {"longest": longest})
    return spark.read.format(FileTree.name()).options(survey=held, **limits).load()


def read(spark: SparkSession, roots: list[str], respect_ignore: bool = True, max_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(inputs path, identity, content; errors path, message) of file trees."""
    all_ = rows(spark, survey(roots, respect_ignore), max_bytes)
    return all_.where("error is null").select("path", "identity", "content"), all_.where("error is not null").select("path", F.col("error").alias("message"))


def given(spark: SparkSession, stream, max_bytes: int, name: str = "<stdin>") -> tuple[DataFrame, DataFrame]:
    """(input, errors) of one stream of bytes, of which no more than the limit and one byte is read."""
    data = stream.read(max_bytes + 1)
    over = len(data) > max_bytes
    inputs = spark.createDataFrame([] if over else [(name, name, bytearray(data))], "path string, identity string, content binary")
    errors = spark.createDataFrame([(name, f"input exceeds {max_bytes} byte limit")] if over else [], "path string, message string")
    return inputs, errors
