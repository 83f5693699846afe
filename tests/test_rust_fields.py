"""A public field's type in a Rust source is no credential; whatever is doubtful stays a finding."""

import base64

import pytest

from sieveline.functions import rust
from sieveline.operators import scan
from sieveline.plans import rules as R

VALUE = "KspDemo_7zQ2mX9pL4vN6sR8"


def scanned(spark, *rows, config=None):
    inputs = spark.createDataFrame([(p, f"{i}", bytearray(t.encode() if isinstance(t, str) else t), i) for i, (p, t) in enumerate(rows)], "path string, identity string, content binary, i int")
    out = [[] for _ in rows]
    for r in scan.findings(inputs, config, secrets=True).orderBy("i", "start").collect():
        out[r.i].append((r.rule_id, r.secret))
    return out


def none_and_some(spark, none, some):
    """Sources without findings, and sources with one of the unquoted rule each, in one scan."""
    found = scanned(spark, *(("fixture.rs", t) for t in [*none, *some]))
    assert found[: len(none)] == [[]] * len(none)
    missed = [t[:80] for t, own in zip(some, found[len(none) :], strict=True) if not any(i == "generic-credential-unquoted" for i, _ in own)]
    assert missed == []


def test_visibilities(spark):
    good = ["pub", "pub(crate)", "pub(self)", "pub(super)", "pub ( crate )", "pub(in crate)", "pub(in self)", "pub(in super::super)", "pub(in self::super)", "pub(in self::super::super)"]
    good += ["pub(in crate::settings)", "pub ( in\tcrate :: settings )", "pub(in crate::r#type)", "pub(in crate::配置)", "pub(in crate::_settings)", "pub(in crate::async)", "pub(in crate::await)"]
    good += ["pub(in crate::dyn)", "pub(in crate::try)", "pub(in crate::gen)", "pub(in settings)", "pub(in ::settings)", "pub(in::settings)"]
    good += ["pub(in /* rationale */ crate)", "pub /* public */ (crate)", "pub(in // rationale\ncrate)"]
    bad = ["pub()", "pub(foo)", "pub(in)", "pub(incrate)", "pub(in crate settings)", "pub(in crate:settings)", "pub(in crate::)", "pub(in crate :: ::settings)", "pub(in crate::123)", "pub(in crate::_)"]
    bad += ["pub(crate) trailing", "pub(in fn)", "pub(in crate::type)", "pub(in Self)", "pub(in r#crate)", "pub(in r#self)", "pub(in crate::self)", "pub(in crate::crate)", "pub(in crate::super)"]
    bad += ["pub(in settings::super)", "pub(in ::crate)", "pub(in ::self)", "pub(in ::super)", "pub(in $crate)"]
    bad += [f"pub(in {c} crate)" for c in ("/** rationale */", "/*! rationale */", "/// rationale\n", "//! rationale\n")]
    none_and_some(spark, [f"    {v} access_token: String,\n" for v in good], [f"{v} access_token: String,\n" for v in bad])


def test_places_in_the_source(spark):
    field = f"pub(crate) password: {VALUE}"
    literals = [f"{o}\n{v} password: {VALUE}\n{c}\n" for o, c in (('r#"', '"#'), ('br##"', '"##'), ('cr###"', '"###'), ('"', '"'), ("/*", "*/"), ("/* outer /* nested */", "*/")) for v in ("pub", "pub(crate)")]
    comments = [f"pub // password: {VALUE}\nstruct S;", f"pub /* password: {VALUE}\n*/ struct S;", f"struct S {{ pub(in /* password: {VALUE}\n*/ crate) access_token: String }}"]
    macros = [f"config! {{\n {field}\n}}", f"macro_rules! r#config {{ () => {{\n {field}\n}}; }}", f"#[config(\n {field}\n)] struct S;"]
    macros += [f"#![feature(decl_macro)]\n{s} {{\n {field}\n}}" for s in ("macro config()", "macro r#config($value:ident)", "macro config")]
    macros += [f"config! {o} {wrong}\n {field}\n{c}" for o, wrong, c in (("{", ")", "}"), ("(", "]", ")"), ("[", "}", "]"))]
    deep = [f"config! {{{'{' * 4096}\n {field}\n{'}' * 4096}}}", "{" * 16384 + f"\n{field}\n", f"pub(in /*{' ' * 16384}*/ crate) password: {VALUE}\n"]
    clean = ['const NOTE: &str = r#"not code: pub(crate)"#;\n/* pub */\nstruct C {\n    pub(crate) access_token: String,\n}\n', "mod nested {\n" * 4096 + "struct S {\n pub(crate) access_token: String,\n}\n" + "}\n" * 4096]
    clean += [f"fn f(enabled: bool) {{ if {c} {{ struct S {{\n pub(crate) access_token: String,\n}} }} }}" for c in ("!enabled", "!{ enabled }")]
    clean += [f"struct S {{\n {v} r#password: String,\n}}" for v in ("pub", "pub(crate)", "pub(in /* scope */ crate)")]
    clean += ["struct S<'a> {\n    c: char = 'x',\n    pub client_secret: std::string::String,\n}\n"]
    none_and_some(spark, clean, literals + comments + macros + deep)


def test_only_types_of_public_fields_are_left_out(spark):
    rows = [("settings.yaml", "pub(crate) password: String,\n"), ("settings.rs", "pub(crate) password = String;\n"), ("settings.rs", 'pub(crate) password: "String",\n'), ("settings.yaml", "password: String\n")]
    rows += [("settings.rs", "pub access_token: String, password=synthetic987;\n"), ("settings.rs", "pub(in crate :: settings) access_token: String, password: synthetic987;\n")]
    found = scanned(spark, *rows)
    assert [own[-1][1] for own in found] == ["String"] * 4 + ["synthetic987"] * 2
    assert [len(own) for own in found] == [1] * 6
    token = "ghp_" + "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0zA1bC2"
    assert [i for i, _ in scanned(spark, ("s.rs", f"pub(crate) access_token: {token},\n"), config=scan.Config(providers=True))[0]] == ["github-pat"]


def test_encoded_sources_and_other_rules_are_not_touched(spark):
    run = base64.b64encode(f"pub(crate) password: {VALUE}\n".encode()).decode()
    assert [i for i, _ in scanned(spark, ("fixture.rs", run))[0]] == ["generic-credential-unquoted"]
    own = R.Rule("generic-credential-unquoted", "Custom credential", "password: ([A-Za-z0-9]+)", 1, confidence="high")
    for builtin in (False, True):
        found = scanned(spark, *(("fixture.rs", f"{v} password: SyntheticValueA93,\n") for v in ("pub", "pub(in crate :: settings)")), config=scan.Config((own,), builtin))
        assert all(any(i == own.id for i, _ in f) for f in found)
    assert scanned(spark, ("bad.rs", b"\xff pub password: String,\n"))[0] != []  # no text: nothing is left out


@pytest.mark.parametrize("text", ["", "'", '"', "r#\"", "/*", "b'\\", "r#", "#", "pub", "pub(", "\\", "1..2 1.5e3 'a 'b' '\\u{1F600}'", "é" * 50 + " pub x"])
def test_odd_sources_end(text):
    assert all(a < b for _, a, b in rust.tokens(text)) and isinstance(rust.public_fields(text), list)


def test_long_sources_take_linear_time():
    import time

    def timed(n):
        began = time.time()
        assert len(rust.public_fields("struct S {\n    pub password: String,\n}\n" * n)) == n
        return time.time() - began

    timed(1000)
    assert timed(40_000) < 20 * max(timed(4_000), 0.05)
