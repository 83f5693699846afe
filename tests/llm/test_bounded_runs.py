"""What a Python worker holds at a time is bounded by characters, whatever the size of the batch that it gets."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from sieveline.llm import jaccard


class _Held(Exception):
    pass


def test_the_pipelines_encoder_works_on_about_a_million_characters_at_a_time(spark, docs, monkeypatch):
    import corpus_pipeline

    df, ran = docs("a"), []

    def hold(self, run, schema):
        ran.append(run)
        raise _Held

    monkeypatch.setattr(type(df), "mapInArrow", hold)
    with pytest.raises(_Held):
        corpus_pipeline.bpe_round_trip(spark, df, "")
    texts = ["", None, *(f"text {i} " + "some words " * 9_000 for i in range(30)), "x " * 700_000, "end"]  # one is longer than a run
    other = [pa.array(range(len(texts)), pa.int64()), *[pa.array([""] * len(texts))] * 3]
    out = list(ran[0](iter([pa.RecordBatch.from_arrays([*other, pa.array(texts)], names=["c0", "c1", "c2", "c3", "text"])])))
    assert [t for b in out for t in b.column("decoded").to_pylist()] == [t or "" for t in texts]
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(len(texts)))
    sizes = [(b.num_rows, pc.sum(pc.binary_length(b.column("decoded"))).as_py()) for b in out]
    assert all(rows == 1 or chars <= 1 << 20 for rows, chars in sizes) and len(out) < 10, sizes


def test_sets_of_shingles_are_made_of_a_quarter_of_a_million_bytes_at_a_time():
    texts = [" ".join(f"w{i}-{j % 700}" for j in range(2_000)) for i in range(60)] + [" ".join(f"v{j}" for j in range(60_000)), None, "one two"]
    runs = list(jaccard._sets(pa.array(texts, pa.string()), 5))
    assert [x for first, end, _ in runs for x in range(first, end)] == list(range(len(texts)))
    assert [len(s) for _, _, sets in runs for s in sets] == [700] * 60 + [59_996, 0, 1]
    assert all(end - first == 1 or sum(len(t or "") for t in texts[first:end]) <= 1 << 18 for first, end, _ in runs) and len(runs) < 12
