"""Fill-in-middle against a plain version."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sieveline.llm import fim

TEXTS = ["a\nb\nc\n", "", None, "one line", "\n\n\n", "é😀\r\nx\n漢字", "has <M> in it\nand more\n", "x\n" * 3000, "z" * 5000, "a\x00b c\nd", "tail<\nS>\n", "<S\n>P>\n<"]


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fim_equals_the_plain_version(docs):
    texts = TEXTS * 8  # the same text under several ids: other borders, both forms
    got = {r.doc_id: r for r in fim.digest(docs(*texts)).collect()}
    assert len(got) == len(texts) and {r.form for r in got.values()} == {"plain", "psm", "spm"}
    for i, t in enumerate(texts):
        n, form, p, m, out = plain(i, t)
        assert tuple(got[i])[1:] == (n, form, p, m, sha(out), sha(t or ""))


def test_rate_and_order(docs):
    texts = ["a\nb\nc\nd\n"] * 200
    got = {r.doc_id: r for r in fim.transform(docs(*texts), rate=40, spm=10).collect()}
    assert all((got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars, got[i].output) == plain(i, t, 40, 10) for i, t in enumerate(texts))


def test_null_and_repeated_ids_extra_columns_empty_table(docs):
    df = docs("a\nb", "a\nb", None, ids=[None, None, 5]).withColumn("x.y", F.lit(3))
    rows = fim.transform(df).collect()
    assert [r["x.y"] for r in rows] == [3] * 3
    assert sorted((r.output for r in rows if r.doc_id is None)) == [plain(None, "a\nb")[4]] * 2
    assert fim.digest(docs("a").where("false")).collect() == []
    with pytest.raises(ValueError, match="form"):
        fim.transform(docs("a").withColumn("Form", F.lit(1)))


def test_pieces_of_a_long_text_give_the_same_units(monkeypatch):
    text = "".join(f"{'w' * (i % 90)}\n" for i in range(400)) + "end"
    whole = fim.Units().ends(text).tolist()
    monkeypatch.setattr(fim, "PIECE", 50)
    assert fim.Units().ends(text).tolist() == whole == [m.end() for m in re.finditer(fim.LINES, text)]


def test_sentinels_that_texts_could_complete_are_refused(docs):
    with pytest.raises(ValueError):
        fim.Sentinels("<a<", "<b", "<c")
    marks = fim.Sentinels("[P", "[S", "[M")
    df = fim.transform(docs("x\ny\nz\n", "[\nP\n", ids=[1, 2]), sentinels=marks)
    back = df.select("doc_id", fim.restored(F.col("output"), F.col("form"), marks).alias("t")).collect()
    assert dict(map(tuple, back)) == {1: "x\ny\nz\n", 2: "[\nP\n"}
