"""The Base64 queries on whole texts, against brute force."""

import base64
import hashlib
import re

from sieveline.plans import queries


def _coded(text, i):
    return f"{text}\n{base64.b64encode(f'password = "inside-{i}"'.encode()).decode()} ."


def test_runs_far_into_a_text(spark, tmp_path):
    late = base64.b64encode(b'password = "Far-0ut-of-Sight"').decode()
    texts = ["short", "word " * 100 + late + " end", "é " * 300 + "A" * 30, "-" * 250 + " " + late]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    runs = sorted((i, x, len(x)) for i, t in enumerate(texts) for x in re.findall(r"[A-Za-z0-9+/_-]{24,}={0,2}", _coded(t, i)))
    assert sorted(tuple(r) for r in queries.base64_candidates(spark, str(tmp_path)).collect()) == runs
    found = {(r.doc_id, r.secret_sha256) for r in queries.base64_findings(spark, str(tmp_path)).collect()}
    secrets = [(i, f"inside-{i}") for i in range(4)] + [(1, "Far-0ut-of-Sight"), (3, "Far-0ut-of-Sight")]
    assert found == {(i, hashlib.sha256(x.encode()).hexdigest()) for i, x in secrets}
