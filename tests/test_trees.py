"""File trees read by their literal names, scan contexts of the command line, archives in Git."""

import gzip
import json
import os
import subprocess

from sieveline.operators import scan
from sieveline.plans import rules as R
from sieveline.sources import files, git

SECRET = "aB3dE5gH7jK9mN1pQ2rS4tU6"
RULE = R.Rule("fixture", "Fixture", "fixture_([A-Za-z0-9]{24})", 1, ("fixture_",))
CONFIG = scan.Config((RULE,), builtin=False)
TEXT = f"fixture_{SECRET}\n"
LITERAL = ("[id].tsx", "{a}.py", "100%.txt", "a b  c.txt", "star*.txt", "what?.txt", "~tilde", "back\\slash", "d.txt", "i.txt", "é😀.txt", ".[x]", "_under")


def test_names_are_never_patterns(spark, tmp_path):
    for name in LITERAL:
        (tmp_path / name).write_text(TEXT)
    (tmp_path / "[dir]*").mkdir()
    (tmp_path / "[dir]*" / "{f}").write_text(TEXT)
    inputs, errors = files.read(spark, [str(tmp_path)])
    rows = inputs.collect()
    assert sorted(r.path for r in rows) == sorted([*LITERAL, "[dir]*/{f}"]) and errors.count() == 0  # each once
    assert {r.identity for r in rows} == {str(tmp_path / r.path) for r in rows}
    assert len(scan.findings(inputs, CONFIG).collect()) == len(rows)
    alone, _ = files.read(spark, [str(tmp_path / "[id].tsx")])
    assert [(r.path, bytes(r.content).decode()) for r in alone.collect()] == [("[id].tsx", TEXT)]


def test_names_that_are_no_utf8(spark, tmp_path):
    with open(os.fsencode(tmp_path) + b"/bad-\xff.txt", "w") as f:
        f.write(TEXT)
    found = scan.findings(files.read(spark, [str(tmp_path)])[0], CONFIG).collect()
    assert [r.path for r in found] == ["bad-�.txt"]


def _read(known, max_bytes=1 << 20, longest=None):
    reader = files.FileReader(known, max_bytes, longest)
    shares = reader.partitions()
    return [row for s in shares for b in reader.read(s) for row in b.to_pylist()], shares


def test_what_goes_after_the_walk_is_an_error_row(tmp_path):
    for name in ("stays.txt", "goes.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    named = files.survey([str(tmp_path / "goes.txt")])
    walked = files.survey([str(tmp_path)])
    (tmp_path / "goes.txt").unlink()
    (tmp_path / "sub").rmdir()
    assert [(r["path"], r["error"]) for r in _read(named)[0]] == [("goes.txt", "input could not be read (FileNotFoundError)")]
    rows = {r["path"]: r["error"] for r in _read(walked)[0]}
    assert rows == {"stays.txt": None, str(tmp_path / "sub"): "directory traversal failed"}


def test_large_folders_are_split_and_small_ones_share_a_task(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SHARE", 10)
    for d in range(12):
        (tmp_path / f"d{d}").mkdir()
        (tmp_path / f"d{d}" / "f").write_text("x")
    for i in range(95):
        (tmp_path / f"f{i}").write_text("x")
    rows, shares = _read(files.survey([str(tmp_path)]))
    assert len(rows) == len({r["path"] for r in rows}) == 107
    assert 10 <= len(shares) <= 20 and max(len(s.folders) for s in shares) > 1


def test_limits_of_length(spark, tmp_path):
    for n in (1, 5, 9, 50):
        (tmp_path / f"{n}").write_text("x" * n)
    known = files.survey([str(tmp_path), str(tmp_path / "none")])
    everything = {r["path"]: r["error"] for r in _read(known, 20)[0]}
    assert everything["50"] == "input exceeds 20 byte limit" and everything[str(tmp_path / "none")] == "input path does not exist"
    rows = files.rows(spark, known, longest=8)
    assert sorted(r.path for r in rows.where("error is null").collect()) == ["1", "5"]
    assert rows.where("error is not null").count() == 1 and rows.where("length < 3").count() == 1 and rows.count() == 3


def _cli(capsys, *args):
    from sieveline.__main__ import main

    try:
        code = main([str(a) for a in args])
    except SystemExit as e:
        code = e.code
    out = capsys.readouterr().out
    return code, [json.loads(x) for x in out.splitlines() if x.startswith("{")]


def test_baselines_belong_to_roots_policy_and_rules(spark, tmp_path, capsys):
    tree, kept = tmp_path / "tree", tmp_path / "kept"
    (tree / "clean").mkdir(parents=True)
    (tree / "a.txt").write_text('password = "hunter2abc"\n')
    assert _cli(capsys, "--write-baseline", kept, "scan", tree)[0] == 1
    assert _cli(capsys, "--baseline", kept, "scan", f"{tree}/clean/..")[0] == 0  # the same root by another name
    for args in (("scan", tree / "clean"), ("scan", "--no-ignore", tree)):
        assert _cli(capsys, "--baseline", kept, *args)[0] == 2 == _cli(capsys, "--write-baseline", kept, *args)[0]
    assert _cli(capsys, "--no-base64", "--baseline", kept, "scan", tree)[0] == 2
    assert _cli(capsys, "--baseline", kept, "--write-baseline", kept, "scan", tree)[0] == 2  # refused together
    assert _cli(capsys, "--baseline", kept, "scan", tree)[0] == 0  # still the old one
    (tree / ".ignore").write_text("other\n")
    assert _cli(capsys, "--baseline", kept, "scan", tree)[0] == 2


def test_contexts_follow_every_ignore_file(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "user"))
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", str(tmp_path / "none"))
    from sieveline.plans import context as C

    tree = tmp_path / "tree"
    (tree / "sub").mkdir(parents=True)
    (tree / "f").write_text("x")
    digests = []

    def step():
        digests.append(C.policy_digest(files.survey([str(tree)]).policy))

    step()
    (tree / ".gitignore").write_text("unrelated\n"), step()
    (tree / ".gitignore").write_text("f\n"), step()
    (tree / "sub" / ".ignore").write_text("x\n"), step()
    (tmp_path / "user" / "git").mkdir(parents=True)
    (tmp_path / "user" / "git" / "ignore").write_text("y\n"), step()
    subprocess.run(["git", "init", "-q", str(tree)], check=True), step()
    (tree / ".git" / "info").mkdir(exist_ok=True)
    (tree / ".git" / "info" / "exclude").write_text("z\n"), step()
    assert len(set(digests)) == len(digests)
    digests.append(C.policy_digest(files.survey([str(tree)], respect_ignore=False).policy))
    assert len(set(digests)) == len(digests)
    step()
    assert digests[-1] == digests[-3]


def test_dispositions_stay_when_a_baseline_is_written_again(spark, tmp_path, capsys):
    from pyspark.sql import functions as F

    from sieveline.operators import baseline

    tree, kept = tmp_path / "tree", str(tmp_path / "kept")
    tree.mkdir()
    (tree / "a.txt").write_text('password = "hunter2abc"\n')
    _cli(capsys, "--write-baseline", kept, "scan", tree)
    old, own = baseline.read(spark, kept)
    baseline.write(old.withColumn("disposition", F.lit("known")), kept, own)
    (tree / "b.txt").write_text('password = "other3xyz"\n')
    _cli(capsys, "--write-baseline", kept, "scan", tree)
    assert sorted(str(r.disposition) for r in baseline.read(spark, kept)[0].collect()) == ["None", "known"]


def test_providers_keys_and_stats_of_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("ghp_" + "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0zA1bC2\n")
    (tmp_path / "t" / "big").write_text("x" * 200)
    (tmp_path / "key").write_bytes(bytes(range(32)))
    (tmp_path / "short").write_bytes(b"x")
    assert _cli(capsys, "scan", tmp_path / "t")[0] == 0
    code, plain = _cli(capsys, "--providers", "--max-bytes", 100, "scan", tmp_path / "t")
    assert code == 2 and [x["finding"]["rule_id"] for x in plain if x["type"] == "finding"] == ["github-pat"]
    assert plain[-1]["stats"] == {"files": 1, "bytes": 41, "skipped": 1, "detection_passes": 1}
    _, keyed = _cli(capsys, "--providers", "--fingerprint-key-file", tmp_path / "key", "scan", tmp_path / "t")
    assert keyed[0]["finding"]["fingerprint"] != plain[0]["finding"]["fingerprint"]
    assert _cli(capsys, "--fingerprint-key-file", tmp_path / "short", "scan", tmp_path / "t")[0] == 2


def test_stats_are_counted_in_the_scan_itself(spark, tmp_path):
    """The source is read once: the plan of the scan has one Python read, and counting adds none."""
    from sieveline.operators import report

    (tmp_path / "a.txt").write_text(TEXT)
    (tmp_path / "b.txt").write_text("none")
    rows = files.rows(spark, files.survey([str(tmp_path)]))
    seen, counted = report.observed(rows)
    found = scan.findings(seen.drop("length"), CONFIG)
    assert found._jdf.queryExecution().executedPlan().toString().count("sieveline_files") == 1
    assert found.where("error is null").count() == 1
    assert report.told(spark, counted).first().asDict() == report.stats(rows.select("length"), 1 << 20).first().asDict()


def _git(place, *args):
    out = subprocess.run(["git", "-C", str(place), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)
    return out.stdout.decode().strip()


def test_archives_in_git(spark, tmp_path):
    """Members keep their paths and fingerprints in the index and in every commit; the index's content wins."""
    packed = gzip.compress(TEXT.encode(), mtime=0)
    (tmp_path / "a-other.txt.gz").write_bytes(packed), (tmp_path / "z-target.txt.gz").write_bytes(packed)
    _git(tmp_path, "init", "-q"), _git(tmp_path, "add", ".")
    (tmp_path / "z-target.txt.gz").write_bytes(b"broken in the working tree")
    config = scan.Config((R.Rule("fixture", "F", RULE.pattern, 1, RULE.keywords, path=r"z-target\.txt\.gz!z-target\.txt$"),), builtin=False)
    member = "z-target.txt.gz!z-target.txt"
    direct = scan.findings(spark.createDataFrame([(member, member, bytearray(TEXT.encode()))], "path string, identity string, content binary"), config).first()
    found, errors = git.staged(spark, str(tmp_path), config)
    assert [(r.path, r.fingerprint, r.coordinate_space) for r in found.collect()] == [(member, direct.fingerprint, "archive_member_bytes")] and errors.count() == 0
    _git(tmp_path, "commit", "-qm", "1"), _git(tmp_path, "commit", "--allow-empty", "-qm", "2")
    found, errors = git.history(spark, str(tmp_path), config=config)
    want = {f"git:{c}:{member}" for c in _git(tmp_path, "log", "--format=%H").split()}
    rows = found.collect()
    assert {r.path for r in rows} == want and len(rows) == 2 and {r.fingerprint for r in rows} == {direct.fingerprint} and errors.count() == 0


def test_archive_errors_in_git_are_those_of_every_commit(spark, tmp_path):
    packed = gzip.compress(b"X" * 4096)
    (tmp_path / "oversized.txt.gz").write_bytes(packed)
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "good.txt").write_text(TEXT)
    _git(tmp_path, "init", "-q"), _git(tmp_path, "add", ".")
    found, errors = git.staged(spark, str(tmp_path), CONFIG, 256)
    assert [r.path for r in found.collect()] == ["good.txt"]
    assert {r.path for r in errors.collect()} == {"broken.zip", "oversized.txt.gz!oversized.txt"}
    _git(tmp_path, "commit", "-qm", "1")
    commit = _git(tmp_path, "rev-parse", "HEAD")
    found, errors = git.history(spark, str(tmp_path), config=CONFIG, max_bytes=256)
    assert [r.path for r in found.collect()] == [f"git:{commit}:good.txt"]
    assert {r.path for r in errors.collect()} == {f"git:{commit}:broken.zip", f"git:{commit}:oversized.txt.gz!oversized.txt"}


def test_git_names_that_are_no_utf8(spark, tmp_path):
    _git(tmp_path, "init", "-q")
    with open(os.fsencode(tmp_path) + b"/bad-\xff.txt", "w") as f:
        f.write(TEXT)
    _git(tmp_path, "add", ".")
    assert [r.path for r in git.staged(spark, str(tmp_path), CONFIG)[0].collect()] == ["bad-�.txt"]
    _git(tmp_path, "commit", "-qm", "1")
    assert [r.path.split(":")[-1] for r in git.history(spark, str(tmp_path), config=CONFIG)[0].collect()] == ["bad-�.txt"]


def test_members_are_handed_on_in_parts(spark, monkeypatch):
    import io
    import zipfile

    from pyspark.sql import functions as F

    from sieveline.sources import archives

    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(50):
            z.writestr(f"m{i}", b"x" * 1000)
    monkeypatch.setattr(archives, "BATCH", 5000)
    rows = spark.createDataFrame([("a.zip", "a.zip", bytearray(sink.getvalue()), 7), ("t", "t", bytearray(b"1"), 8)], "path string, identity string, content binary, n int")
    out = archives.expand(rows.withColumn("error", F.when(F.col("n") == 8, "failed before")))
    assert out.where("n = 7 and error is null and is_member").count() == 50
    assert [(r.path, r.error) for r in out.where("n = 8").collect()] == [("t", "failed before")]
