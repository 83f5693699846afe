"""Behaviour of the scanner on small inputs."""

import base64

import pytest
from pyspark.sql import functions as F

from sieveline.operators import baseline, report, scan
from sieveline.plans import rules as R

SIMPLE = R.Rule("fixture", "Fixture", "fixture_([A-Za-z0-9]{24})", 1, ("fixture_",), confidence="high")
VALUE = "fixture_" + "aB3dE5gH7jK9mN1pQ2rS4tU6"


def found(spark, rows, config=None, **more):
    inputs = spark.createDataFrame([(p, p, c if isinstance(c, (bytes, bytearray)) else c.encode()) for p, c in rows], "path string, identity string, content binary")
    return scan.findings(inputs, config, **more).orderBy("path", "start", "rule_id").collect()


def only(*rules, **more):
    return scan.Config(rules, builtin=False, **more)


def test_spans_lines_and_columns_are_bytes(spark):
    rows = found(spark, [("a", b"\xff\xc3\xa9\nx " + VALUE.encode() + b"\n")], only(SIMPLE), secrets=True)
    assert [(r.start, r.end, r.line, r.column, r.secret) for r in rows] == [(14, 38, 2, 10, VALUE[8:])]


def test_no_column_holds_the_secret(spark):
    rows = found(spark, [("a", VALUE)], only(SIMPLE))
    assert rows and all(VALUE[8:] not in str(v) for r in rows for v in r)
    assert rows[0].redacted == "[REDACTED]"


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ('password = "hunter2abc"', True),
        ("password: 'abcd1234',", True),
        ("my_api-key=Abcd1234;", True),
        ("secret = s3cretValue\r\n", True),
        ('password =\n   "next-line-9"', True),
        ('password = "abc"', False),
        ('password = "changeme"', False),
        ('password = "your_password"', False),
        ('secret: "${VAULT_SECRET}"', False),
        ('api_key = "process.env.KEY1"', False),
        ("api_key = config.keys.main", False),
        ('password = "aaaaaaaaaa"', False),
        ('password = "abc" + "def"', False),
        ('auth_token = "rotate this, since it is no longer a valid one."', False),
        ('password = "correct horse battery staple, and four more words here."', True),
        ("xpassword1 = abcd1234;", False),
        ("ê" + "password='abcd1234'", True),
    ],
)
def test_assigned_literals(spark, text, hit):
    assert bool(found(spark, [("a", text)])) is hit


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("postgres://user:p4ss@db/x", True),
        ("https://u:secret1@[::1]/", True),
        ("rediss://:onlypass@cache", True),
        ("https://user@host/", False),
        ("https://user:@host/", False),
        ("postgres://u:${PW}@db", False),
        ("mysql://u:example@db", False),
        ("ftp://u:secret1@db", False),
    ],
)
def test_uri_passwords(spark, text, hit):
    assert any(r.rule_id == "uri-userinfo-password" for r in found(spark, [("a", text)])) is hit


def test_primary_rule_and_sorted_ids(spark):
    rules = [R.Rule(i, i, "tok_([a-z0-9]{8})", 1, confidence=c) for i, c in (("generic-a", "high"), ("provider-z", "medium"), ("provider-b", "high"), ("provider-a", "high"))]
    (row,) = found(spark, [("a", "tok_abcd1234")], only(*rules))
    assert row.rule_id == "provider-a"
    assert row.matched_rule_ids == ["generic-a", "provider-a", "provider-b", "provider-z"]


def test_base64_reports_the_run(spark):
    run = base64.b64encode(f"x {VALUE} y".encode()).decode()
    (row,) = found(spark, [("a", f"data {run} end")], only(SIMPLE))
    assert (row.start, row.end, row.is_base64_encoded) == (5, 5 + len(run), True)
    assert not found(spark, [("a", f"data {run} end")], only(SIMPLE, base64=False))
    url = base64.urlsafe_b64encode(f"??>>{VALUE}~~".encode()).decode().rstrip("=")
    assert found(spark, [("a", url)], only(SIMPLE))


def test_entropy_is_strict(spark):
    rule = R.Rule("e", "E", "k=([ab]+)", 1, min_entropy=1.0)
    assert not found(spark, [("a", "k=abab")], only(rule))
    assert found(spark, [("a", "k=abab")], only(rule, min_entropy=0.9))


def test_allowlists(spark):
    def hits(*allow):
        return len(found(spark, [("src/a", "key k=stopab1 # ok\nkey k=other9")], only(R.Rule("r", "R", "k=([a-z0-9]+)", 1, allowlist=allow))))

    assert hits() == 2
    assert hits(R.Allow(stopwords=("STOP",))) == 1
    assert hits(R.Allow(target="line", regexes=("# ok",))) == 1
    assert hits(R.Allow(target="match", regexes=("^k=other",))) == 1
    assert hits(R.Allow("and", stopwords=("stop",), regexes=("zzz",))) == 2
    assert hits(R.Allow(paths=("^src/",))) == 0
    assert hits(R.Allow("and", paths=("^src/",), stopwords=("stop",))) == 1


def test_paths(spark):
    rule = R.Rule("r", "R", "k=([a-z]+)", 1, path=r"\.py$", exclude_paths=("test",))
    assert [r.path for r in found(spark, [("a.py", "k=ab"), ("a.js", "k=ab"), ("test.py", "k=ab")], only(rule))] == ["a.py"]


def test_gate_changes_nothing(spark):
    from sieveline.functions.text import latin1
    from sieveline.operators import detect

    rows = [(("tok token TOKEN " * (i % 3)) + ('Token = "%040x"' % (i * 7919)) * (i % 2) + "é",) for i in range(64)]
    view = spark.createDataFrame(rows, "t string").select(latin1(F.encode("t", "UTF-8")).alias("v"))
    rule = R.Rule("r", "R", r'(?i)token = "([0-9a-f]{40})"', 1, ("token",))
    both = view.select(*(detect.candidates(F.col("v"), F.lower("v"), F.lit("p"), rule, gate=g).alias(n) for g, n in ((True, "a"), (False, "b"))))
    assert both.where("not (a <=> b)").count() == 0
    assert both.where("size(a) > 0").count() == 32


@pytest.mark.parametrize(
    "rule",
    [
        R.Rule("", "x", "a"), R.Rule("r", "x", "a*"), R.Rule("r", "x", "("), R.Rule("r", "x", "a", 1), R.Rule("r", "x", "a", keywords=("",)), R.Rule("r", "x", "a", min_entropy=9.0),
        R.Rule("r", "x", "a", path="("), R.Rule("r", "x", "a", allowlist=(R.Allow(),)), R.Rule("r", "x", "a", allowlist=(R.Allow(stopwords=("",)),)), R.Rule("r", "x", "a", allowlist=(R.Allow(regexes=("(",)),)),
    ],
)
def test_bad_rules_are_refused_without_their_pattern(spark, rule):
    with pytest.raises(R.RuleError) as e:
        R.check([rule])
    assert "(" not in str(e.value)


def test_rule_files(tmp_path):
    (tmp_path / "a.json").write_text('{"rules":[{"id":"x","name":"X","pattern":"a"},{"id":"y","name":"Y","pattern":"b","confidence":"high"}]}')
    (tmp_path / "b.json").write_text('{"rules":[{"id":"x","name":"X2","pattern":"c"}]}')
    rules = R.override(R.load(tmp_path))
    assert [(r.id, r.name) for r in rules] == [("x", "X2"), ("y", "Y")]
    assert [r.id for r in R.select(rules, "high")] == ["y"]
    with pytest.raises(R.RuleError):
        R.parse('{"rules":[{"id":"x","name":"X","pattern":"a","extra":1}]}')
    with pytest.raises(R.RuleError):
        R.select([rules[0]], "high")


def test_baselines(spark):
    def scanned(*texts):
        rows = [(f"f{i}", f"f{i}", t.encode()) for i, t in enumerate(texts)]
        return scan.findings(spark.createDataFrame(rows, "path string, identity string, content binary"), only(SIMPLE))

    other = "fixture_" + "zY8xW6vU4tS2rQ0pO9nM7lK5"
    old, now = scanned(VALUE, VALUE), scanned(VALUE + " " + VALUE, other)
    kept = baseline.from_findings(old, context={"m": 1})
    assert kept.count() == 2
    fresh, gone = baseline.diff(now, kept, context={"m": 1}, baseline_context={"m": 1})
    assert fresh.count() == 1 and gone.count() == 1
    assert baseline.diff(now, kept, complete=False, context={})[1].count() == 0
    with pytest.raises(baseline.ContextError):
        baseline.diff(now, kept, context={"m": 2}, baseline_context={"m": 1})
    with pytest.raises(baseline.ContextError):
        baseline.from_findings(now, complete=False, context={})
    marked = kept.withColumn("disposition", F.lit("known"))
    again = baseline.from_findings(now, marked, context={}, previous_context={})
    assert sorted(str(r.disposition) for r in again.collect()) == ["None", "known"]


def test_reports(spark):
    import json

    inputs = spark.createDataFrame([("/a b.txt", "/a b.txt", VALUE.encode())], "path string, identity string, content binary")
    rows, errors = scan.findings(inputs, only(SIMPLE)), spark.createDataFrame([("bad", "broken")], "path string, message string")
    none = errors.limit(0)
    assert report.summary(rows, errors).first().exit_code == 2
    assert report.summary(rows, none).first().exit_code == 1
    assert report.summary(rows.limit(0), none).first().exit_code == 0
    lines = [json.loads(r.value) for r in report.json_lines(rows, errors, report.summary(rows, errors)).collect()]
    assert [x["type"] for x in lines] == ["finding", "error", "summary"]
    assert "matched_rule_ids" not in lines[0]["finding"]
    doc = json.loads(report.sarif(rows, errors).first().sarif)
    run = doc["runs"][0]
    assert run["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "file:///a%20b.txt"
    assert run["invocations"][0]["executionSuccessful"] is False and len(run["tool"]["driver"]["rules"]) == 1


def test_preview_passes_over_what_does_not_fit(spark):
    rows = [("r", None, p, i, i + 1, "f") for i, p in enumerate(["a", "b" * 300, "c"])]
    df = spark.createDataFrame(rows, "rule_id string, matched_rule_ids array<string>, path string, start long, end long, fingerprint string")
    got = report.preview(df, budget=250).collect()
    assert ['"path":"a"' in got[0].finding, '"path":"c"' in got[1].finding, len(got)] == [True, True, 2]


def test_throttle(spark):
    times = spark.createDataFrame([([0, 0, 1, 99, 100, 101, 199, 200, 450, 451],)], "t array<long>")
    assert times.select(report.throttle(F.col("t")).alias("k")).first().k == [0, 100, 200, 450]


@pytest.mark.parametrize(
    ("pattern", "group", "text", "secret"),
    [
        (r"id=(?:k_([a-z]{4})|t_([a-z]{4}))", None, "id=t_wxyz", "wxyz"),
        (r"id=((?:a|b)([0-9]{4}))", 2, "id=b1234", "1234"),
        (r"key(?:=([a-z]+))?!", 1, "key! key=abcd!", "abcd"),
        (r"é=([a-z]{4})", 1, "é=abcd", "abcd"),
        (r"(x)(y{3})$", 2, "xyyy\nxyyy", "yyy"),
    ],
)
def test_captures_of_any_shape(spark, pattern, group, text, secret):
    rows = found(spark, [("a", text)], only(R.Rule("r", "R", pattern, group)), secrets=True)
    data = text.encode()
    assert [r.secret for r in rows] == [secret]
    assert data[rows[0].start : rows[0].end].decode() == secret and rows[0].start == data.rindex(secret.encode())


def test_kept_baselines(spark, tmp_path):
    from sieveline.plans import context as C

    inputs = spark.createDataFrame([("f", "f", VALUE.encode())], "path string, identity string, content binary")
    rows, own = scan.findings(inputs, only(SIMPLE)), C.context("scan", ["b", "a"], only(SIMPLE))
    baseline.write(baseline.from_findings(rows, context=own), str(tmp_path / "kept"), own)
    back, context = baseline.read(spark, str(tmp_path / "kept"))
    assert context == own and baseline.diff(rows, back, context=own, baseline_context=context)[0].count() == 0
    assert C.configuration_id(only(SIMPLE)) != C.configuration_id(only(SIMPLE, min_entropy=1.0))
    spoiled = back.withColumn("fingerprint", F.lit("other"))
    baseline.write(spoiled, str(tmp_path / "spoiled"), own)
    with pytest.raises(baseline.ContextError):
        baseline.read(spark, str(tmp_path / "spoiled"))


def test_command_line(spark, tmp_path, capsys):
    import json

    from sieveline.__main__ import main

    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.txt").write_text('password = "hunter2abc"\n')
    kept = str(tmp_path / "kept")
    assert main(["--write-baseline", kept, "scan", str(tmp_path / "tree")]) == 1
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["type"] for x in lines] == ["finding", "summary"] and "hunter2" not in json.dumps(lines)
    assert main(["--baseline", kept, "scan", str(tmp_path / "tree")]) == 0
    assert main(["scan", str(tmp_path / "none")]) == 2
    capsys.readouterr()
    assert main(["rules"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 4


def test_preview_looks_at_all_findings(spark):
    """Very many findings that do not fit hide none that does."""
    rows = [("generic", None, "p" * 500 + f"{i:03d}", i, i + 1, 1, 1, "r", "f", "e", "low", False, "s") for i in range(100)]
    rows += [("generic", None, f"z{i}", i, i + 1, 1, 1, "r", "f", "e", "low", False, "s") for i in range(5)]
    found = report.preview(spark.createDataFrame(rows, scan.FINDING), rows=3, budget=1150).collect()
    assert [r.place for r in found] == [0, 1, 2]
    assert [x["path"][:2] for x in (__import__("json").loads(r.finding) for r in found)] == ["pp", "z0", "z1"]


def test_json_document(spark):
    import json

    rows = [("b", None, "p2", 3, 4, 1, 1, "r", "f", "e", "low", False, "s"), ("a", ["a", "b"], "p1", 1, 2, 1, 1, "r", "f", "e", "low", False, "s")]
    found = spark.createDataFrame(rows, scan.FINDING)
    errors = spark.createDataFrame([("q", 'bad "x"')], "path string, message string")
    out = json.loads(report.document(found, errors, report.summary(found, errors)).first()[0])
    assert [f["path"] for f in out["findings"]] == ["p1", "p2"] and out["errors"] == [{"path": "q", "message": 'bad "x"'}]
    assert (out["schema_version"], out["finding_count"], out["complete"], out["exit_code"]) == (1, 2, False, 2)


def test_sums_of_long_arrays(spark):
    from sieveline.operators import detect

    for n in (0, 1, 255, 256, 257, 2000):
        row = spark.range(1).select(detect.running(F.transform(F.slice(F.sequence(F.lit(1), F.lit(3000)), F.lit(1), F.lit(n)), lambda x: x.cast("bigint"))).alias("s")).first()
        assert row.s == [i * (i + 1) // 2 for i in range(n)]


def test_throttle_counts(spark):
    times = spark.createDataFrame([(1, t) for t in (0, 50, 100, 100, 199, 200)] + [(2, 7)], "key long, ms long")
    assert sorted(tuple(r) for r in report.throttle_counts(times).collect()) == [(1, 3), (2, 1)]
