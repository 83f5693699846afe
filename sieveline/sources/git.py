"""Git snapshots as relations: commits, tree entries and blobs, joined.

Each tree is listed once and each blob read and scanned once per path; findings are then joined back to the commits that hold them.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.sources import archives, encodings


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout


def root(place: str) -> str:
    """The top of the working tree that holds a directory, or the directory itself for a bare repository."""
    if _git(place, "rev-parse", "--is-bare-repository").strip() == b"true":
        return place
    return _git(place, "rev-parse", "--show-toplevel").decode(errors="surrogateescape").rstrip("\n")


def commits(spark: SparkSession, repo: str, revisions: str | None = None) -> DataFrame:
    """(commit, tree) of all local refs or of a range of revisions."""
    if revisions is not None and not revisions.strip():
        raise ValueError("an empty revision range")
    out = _git(repo, "log", "--format=%H %T", *([revisions] if revisions else ["--all"]), "--").decode().split()
    return spark.createDataFrame(list(zip(out[::2], out[1::2], strict=True)), "commit string, tree string")


def tree_entries(trees: DataFrame, repo: str) -> DataFrame:
    """(tree, oid, path) of the files of trees (tree), listed by the tasks; links to other repositories are left out."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for tree in pdf["tree"].tolist():
                rows = []
                for line in _git(repo, "ls-tree", "-r", "-z", tree).decode(errors="surrogateescape").split("\0"):
                    if line:
                        head, path = line.split("\t", 1)
                        mode, kind, oid = head.split(" ")
                        if kind == "blob" and mode != "120000":
                            rows.append((tree, oid, path.encode(errors="surrogateescape").decode(errors="replace")))
                yield pd.DataFrame(rows, columns=["tree", "oid", "path"])

    return trees.select("tree").repartition("tree").mapInPandas(run, "tree string, oid string, path string")


def staged_entries(spark: SparkSession, repo: str) -> DataFrame:
    """(oid, path) of files that the index adds or changes."""
    changed = set(_git(repo, "diff", "--cached", "--name-only", "-z", "--diff-filter=ACMR").split(b"\0")) - {b""}
    rows = []
    for line in _git(repo, "ls-files", "--stage", "-z").split(b"\0"):
        if line:
            head, path = line.split(b"\t", 1)
            mode, oid, stage = head.decode().split(" ")
            if stage == "0" and mode not in ("160000", "120000") and path in changed:
                rows.append((oid, path.decode(errors="replace")))
    return spark.createDataFrame(rows, "oid string, path string")


#: Bytes of blobs that are read at a time, about.
_READ = 32 << 20


def blobs(oids: DataFrame, repo: str, max_bytes: int = 64 << 20) -> DataFrame:
    """(oid, content, error) read by the tasks; the repository must be reachable from them.

    Sizes are asked for first: a blob beyond the limit is not read, and a missing object costs that object only.
    """

    def ask(what: str, wanted: list[str]) -> bytes:
        return subprocess.run(["git", "-C", repo, "cat-file", what], input="\n".join(wanted).encode() + b"\n", capture_output=True, check=True).stdout

    def groups(sizes):
        group, total = [], 0
        for oid, size in sizes:
            if group and total + size > _READ:
                yield group
                group, total = [], 0
            group.append(oid)
            total += size
        if group:
            yield group

    def run(frames):
        import pandas as pd

        for pdf in frames:
            heads = [line.split(" ") for line in ask("--batch-check", pdf["oid"].tolist()).decode().splitlines()] if len(pdf) else []
            bad = [(h[0], None, "git object is missing or unreadable") for h in heads if len(h) != 3 or h[1] != "blob"]
            sizes = [(h[0], int(h[2])) for h in heads if len(h) == 3 and h[1] == "blob"]
            bad += [(oid, None, f"blob exceeds {max_bytes} byte limit") for oid, size in sizes if size > max_bytes]
            if bad:
                yield pd.DataFrame(bad, columns=["oid", "content", "error"])
            for group in groups((oid, size) for oid, size in sizes if size <= max_bytes):
                out, at, rows = ask("--batch", group), 0, []
                for oid in group:
                    end = out.index(b"\n", at)
                    size = int(out[at:end].split()[2])
                    rows.append((oid, out[end + 1 : end + 1 + size], None))
                    at = end + 2 + size
                yield pd.DataFrame(rows, columns=["oid", "content", "error"])

    return oids.select("oid").distinct().mapInPandas(run, "oid string, content binary, error string")


def history_entries(spark: SparkSession, repo: str, revisions: str | None = None) -> DataFrame:
    """(tree, oid, path) of the files of all trees of a repository's history."""
    repo = root(repo)
    return tree_entries(commits(spark, repo, revisions).select("tree").distinct(), repo)


def stats(entries: DataFrame, repo: str, max_bytes: int = 64 << 20) -> DataFrame:
    """One row about the blobs of entries (oid, path): each counts once in files, bytes and skipped, and once per path in detection_passes."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            if len(pdf):
                wanted = "\n".join(pdf["oid"]).encode() + b"\n"
                asked = subprocess.run(["git", "-C", repo, "cat-file", "--batch-check"], input=wanted, capture_output=True, check=True)
                heads = [line.split(" ") for line in asked.stdout.decode().splitlines()]
                sizes = [(h[0], int(h[2]) if len(h) == 3 and h[1] == "blob" else None) for h in heads]
                yield pd.DataFrame(sizes, columns=["oid", "length"]).astype({"length": "Int64"})

    paths = entries.groupBy("oid").agg(F.count_distinct("path").alias("paths"))
    known = paths.select("oid").mapInPandas(run, "oid string, length long").join(paths, "oid")
    fits = F.coalesce(F.col("length") <= max_bytes, F.lit(False))
    total = lambda x: F.coalesce(F.sum(F.when(fits, F.col(x))), F.lit(0)).cast("long").alias
    return known.agg(F.count(F.when(fits, 1)).alias("files"), total("length")("bytes"), F.count(F.when(~fits, 1)).alias("skipped"), total("paths")("detection_passes"))


def occurrences(found: DataFrame, entries: DataFrame, history: DataFrame) -> DataFrame:
    """Rows per (oid, path) placed in every commit that holds them: path becomes git:<commit>:<path>, all else stays.

    Rows of archive members have the archive's path in ``repo_path``; where found lacks that column it is the path.
    """
    if "repo_path" not in found.columns:
        found = found.withColumn("repo_path", F.col("path"))
    held = found.join(entries.select("tree", "oid", F.col("path").alias("repo_path")), ["oid", "repo_path"]).drop("repo_path")
    return held.join(history, "tree").withColumn("path", F.concat(F.lit("git:"), "commit", F.lit(":"), "path")).drop("tree")


def inputs(contents: DataFrame, entries: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Of blobs (oid, content, error) and their paths (oid, path): (inputs, archives expanded and UTF-16 decoded, each with its oid and the
    path it has in the repository; errors of blobs that could not be read)."""
    unread = contents.where("error is not null").select(F.concat(F.lit("git-object:"), "oid").alias("path"), F.col("error").alias("message"))
    named = contents.where("error is null").drop("error").join(entries.select("oid", "path").distinct(), "oid")
    named = named.select("oid", F.col("path").alias("repo_path"), "path", F.col("path").alias("identity"), "content")
    return encodings.decoded(archives.expand(named, max_bytes)), unread


def _scanned(contents: DataFrame, entries: DataFrame, config, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    from sieveline.operators import scan

    given, unread = inputs(contents, entries, max_bytes)
    space = F.when(F.col("is_member"), "archive_member_bytes").otherwise("source_bytes")
    return scan.findings(given, config, space).drop("is_member"), unread


def history(spark: SparkSession, repo: str, revisions: str | None = None, config=None, max_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(findings with a commit each, errors) of a repository's history. What an archive or a text of a commit has for errors is an error of that commit."""
    from sieveline.operators import scan

    repo = root(repo)
    log = commits(spark, repo, revisions)
    entries = tree_entries(log.select("tree").distinct(), repo).cache()  # listed once, read by three joins
    found, unread = _scanned(blobs(entries, repo, max_bytes), entries, config, max_bytes)
    placed, errors = scan.parted(occurrences(found, entries, log))
    return placed, unread.unionByName(errors)


def staged(spark: SparkSession, repo: str, config=None, max_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of the index's version of changed files."""
    from sieveline.operators import scan

    repo = root(repo)
    entries = staged_entries(spark, repo)
    found, unread = _scanned(blobs(entries, repo, max_bytes), entries, config, max_bytes)
    placed, errors = scan.parted(found.drop("oid", "repo_path"))
    return placed, unread.unionByName(errors)
