"""What every match holds, derived from patterns."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import literals, regex
from sieveline.functions import text as fn
from sieveline.operators import detect
from sieveline.plans import rules as R


def test_shipped_rules():
    found = {r.id: literals.required(r.pattern) for r in [*R.authored(), *R.providers()]}
    assert found["generic-credential-double"] == r"(?i)(?:ord|swd|pwd|ret|key|ken)[\"\']{0,1}[\ \x09]{0,}[:=]".replace(r"[\"\']", "[\"']")
    assert found["anthropic-api-key"] == r"(?:sk\-ant\-api03\-)[\x00-\xFF]{93}(?:AA)" and found["sendgrid-api-key"] == r"(?:SG\.)[\x00-\xFF]{22}(?:\.)"
    assert found["github-pat"] is None and sum(p is not None for p in found.values()) >= 7


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("fixture_([a-z]{4})", None), ("tok_[0-9]{4}-end", r"(?:tok_)[\x00-\xFF]{4}(?:\-end)"), ("tok_[0-9]+-end", None), ("(?i)x*secret[=:]+", "(?i)(?:secret)[=:]{1,}"), ("[0-9]{2,}(?:abc|xbc)(y?)", "(?:abc|xbc)"),
        ("(?:abc)?[0-9]xyz", "(?:xyz)"), ("(a|b)+c", None), ("(?s).*", None), ("[", None), ("x?(?:[ab]c[de]f)=", "(?:cdf=|cef=)"), (r"\w+\bkey_id\b", "(?:key_id)"), ("a*(?i:secret)", None), (r"[0-9](?:\\path|\.path)", r"(?:path)"),
    ],
)
def test_patterns(pattern, want):
    assert literals.required(pattern) == want


_PART = st.sampled_from(["abc", "key", "[ab]", "x?", "y*", "[0-9]{2}", "(?:foo|bar)", "(?:foo|b)", "(tok)", "=", r"\b", "(?:ab)?", "z{2,3}", "[:=]", "q+"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_PART, min_size=1, max_size=6), st.integers(0, 2**32), st.booleans())
def test_whatever_matches_holds_what_is_required(parts, seed, fold):
    pattern = ("(?i)" if fold else "") + "".join(parts)
    needed = literals.required(pattern)
    if needed is None:
        return
    r = random.Random(seed)
    texts = ["".join(r.choices(["abc", "key", "a", "b", "x", "yy", "12", "foo", "bar", "tok", "=", " ", "ab", "zz", ":", "q", "KEY", "Foo"], k=r.randint(1, 12))) for _ in range(60)]
    for t in texts:
        if re.search(pattern, t):
            assert re.search(needed, t), (pattern, needed, t)


def test_gated_rules_find_the_same(spark):
    """Rules with a shortcut, with and without their gate, on texts with many near misses."""
    r = random.Random(2)
    parts = ["password", "api_key", "secret", '"', "'", " ", "=", ": ", "abcd1234", "\n", ";", ",", "SG.", "A" * 22, ".", "B" * 43, "x", "key", "token", 'pwd = "zq9xk2"\n', "client_secret: zq9xk2\n", f"SG.{'a1' * 11}.{'b2' * 21}c "]
    texts = [("".join(r.choices(parts, k=r.randint(1, 25))),) for _ in range(400)]
    rules = [*R.authored(), *R.providers()]
    view = spark.createDataFrame(texts, "t string").select(fn.latin1(F.encode("t", "UTF-8")).alias("v"))
    kept = literals.required
    found = []
    for on in (True, False):
        detect.literals.required = kept if on else (lambda _: None)
        try:
            own = view.select("v", F.array_sort(detect.all_candidates(F.col("v"), F.col("v"), F.lit("p"), rules)).alias("c"))
            found.append(sorted((x.v, str(x.c)) for x in own.collect()))
        finally:
            detect.literals.required = kept
    assert found[0] == found[1] and sum(x != "[]" for _, x in found[0]) > 20


def test_required_patterns_translate():
    for rule in [*R.authored(), *R.providers()]:
        if (needed := literals.required(rule.pattern)) is not None:
            assert regex.translate(needed).startswith("(?d)")
