"""UTF-16 inputs in every kind of scan, with places in the source."""

import io
import subprocess
import zipfile

import pytest

from sieveline.operators import scan
from sieveline.plans import rules as R
from sieveline.sources import encodings, git
from sieveline.streaming import scan as streaming

RULE = R.Rule("fixture", "Fixture", "fixture_([A-Za-z0-9]{24})", 1, ("fixture_",))
SECRET = "aB3dE5gH7jK9mN1pQ2rS4tU6"
CONFIG = scan.Config((RULE,), builtin=False)
TEXT = f"é😀 one\n😀é fixture_{SECRET} 😀"
GOOD, BAD = b"\xfe\xff" + TEXT.encode("utf-16-be"), b"\xff\xfe\x00\xd8a\x00"


def _inputs(spark, *rows):
    return spark.createDataFrame([(p, p, bytearray(c)) for p, c in rows], "path string, identity string, content binary")


@pytest.mark.parametrize(("mark", "codec"), [(b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")])
def test_places_in_the_source(spark, mark, codec):
    data = mark + TEXT.encode(codec)
    first = mark + f"é fixture_{SECRET}".encode(codec)
    rows = [("two", data), ("first", first), ("utf8", TEXT.encode())]
    got = {r.path: r for r in scan.findings(encodings.decode_utf16(_inputs(spark, *rows))[0], CONFIG).collect()}
    for path, source in (("two", data), ("first", first)):
        assert source[got[path].start : got[path].end] == SECRET.encode(codec)
        assert got[path].explanation.endswith("; decoded UTF-16 BOM text")
    assert (got["two"].line, got["two"].column) == (2, len("😀é fixture_".encode(codec)))
    assert (got["first"].line, got["first"].column) == (1, got["first"].start)
    assert TEXT.encode()[got["utf8"].start : got["utf8"].end] == SECRET.encode() and "UTF-16" not in got["utf8"].explanation


def test_places_inside_characters(spark):
    """A byte span may cut characters: it is widened to whole ones, as the source has no smaller place."""
    from pyspark.sql import functions as F

    raw = "é😀\n😀x".encode().decode("latin1")
    view = spark.createDataFrame([(raw, s, e) for s, e in ((1, 3), (4, 6), (8, 9), (0, 12))], "raw string, s long, e long")
    got = view.select(encodings.source_start(F.col("raw"), F.col("s")), encodings.source_end(F.col("raw"), F.col("e")), encodings.source_column(F.col("raw"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(2, 8, 2), (4, 8, 4), (10, 14, 0), (2, 16, 2)]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from sieveline import __main__ as cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(GOOD)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("m.txt", GOOD)
    (tmp_path / "in" / "z.zip").write_bytes(out.getvalue())
    monkeypatch.setattr(R, "load", lambda p: [RULE])

    def run():
        code = cli.main(["--rules", "given", "--no-builtin", "scan", str(tmp_path / "in")])
        return code, capsys.readouterr().out

    code, out = run()
    assert code == 1 and '"a.txt"' in out and '"z.zip!m.txt"' in out and out.count("decoded UTF-16 BOM text") == 2
    (tmp_path / "in" / "b.txt").write_bytes(BAD)
    code, out = run()
    assert code == 2 and "invalid UTF-16 content" in out


def test_git(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a.txt").write_bytes(GOOD)
    (tmp_path / "b.txt").write_bytes(BAD)
    run("add", ".")
    index, errors = git.staged(spark, str(tmp_path), CONFIG)
    assert [r.path for r in index.collect()] == ["a.txt"] and [r.message for r in errors.collect()] == ["invalid UTF-16 content"]
    run("commit", "-qm", "1")
    found, errors = git.history(spark, str(tmp_path), config=CONFIG)
    got = found.collect()
    assert [GOOD[r.start : r.end].decode("utf-16-be") for r in got] == [SECRET] and [r.message for r in errors.collect()] == ["invalid UTF-16 content"]


def test_streams(spark, tmp_path):
    _inputs(spark, ("good", GOOD)).write.parquet(str(tmp_path / "in"))

    def source():
        return spark.readStream.schema("path string, identity string, content binary").parquet(str(tmp_path / "in"))

    seen, wrong = [], []
    streaming.start(source(), lambda df, _: seen.extend(df.collect()), str(tmp_path / "one"), CONFIG).awaitTermination()
    assert [GOOD[r.start : r.end].decode("utf-16-be") for r in seen] == [SECRET]
    _inputs(spark, ("bad", BAD)).write.mode("append").parquet(str(tmp_path / "in"))
    streaming.start(source(), lambda df, _: None, str(tmp_path / "two"), CONFIG, lambda df, _: wrong.extend(df.collect())).awaitTermination()
    assert [(r.path, r.message) for r in wrong] == [("bad", "invalid UTF-16 content")]
    with pytest.raises(Exception, match="invalid UTF-16 content"):
        streaming.start(source(), lambda df, _: None, str(tmp_path / "three"), CONFIG).awaitTermination()
