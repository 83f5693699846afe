"""The registered queries of the scanner, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import keywords
from sieveline.functions import text as fn
from sieveline.operators import baseline, detect, quality, report, scan
from sieveline.plans import rules as R

TOKEN = R.Rule("corpus-token-assignment", "Token assigned in text", r'token = "([0-9a-f]{40})"', 1, ("token",), 2.0)
TOKENS_ONLY = scan.Config((TOKEN,), builtin=False, base64=False)

#: Lines that are put behind the documents' texts, by doc_id % 8, as the tables hold few of these shapes. The same on both sides.
_LINES = [
    "concat('password = \"S3cr', doc_id, 'xyz\"')",
    "concat('api_key: ''value-', doc_id, '-abc'',')",
    "concat('my_secret=Abcd', doc_id, 'efgh;')",
    "concat('see postgres://user:pw', doc_id, '@db.example/x')",
    "concat('password = \"changeme\" // ', doc_id)",
    "concat('auth_token = \"please rotate this, it is not a real one ', doc_id, '.\"')",
    "concat('api_key = \"process.env.KEY', doc_id, '\"')",
    "concat('access_token = \"aaaaaaaaaa\" # ', doc_id)",
]
_SUFFIX = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_LINES)) + " END"
#: Spark reads a doubled quote inside a literal as two literals side by side, which is why the lines' quotes are escaped for it.
_SPARK_SUFFIX = _SUFFIX.replace("''", "\\'")
_SEEDED = f"SELECT doc_id, source, text || chr(10) || {_SUFFIX} AS text FROM documents"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return scan.spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source"))


def _seeded(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).withColumn("text", F.concat("text", F.lit("\n"), F.expr(_SPARK_SUFFIX)))


def _path() -> Column:
    return F.concat(F.col("source"), F.lit("/./doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))


_SQL_PATH = "source || '/./doc-' || doc_id || '.txt'"


def _scan(df: DataFrame, config: scan.Config, secrets: bool = False) -> DataFrame:
    inputs = df.select("doc_id", _path().alias("path"), fn.logical_identity(_path()).alias("identity"), F.encode("text", "UTF-8").alias("content"))
    return scan.findings(inputs, config, secrets=secrets)


def _secret_hash(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "rule_id", F.sha2(F.encode("secret", "ISO-8859-1"), 256).alias("secret_sha256"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FINGERPRINT = "sha256('20:sieveline/finding/v1,' || strlen(rule_id) || ':' || rule_id || ',' || strlen(identity) || ':' || identity || ',' || strlen(hexed) || ':' || hexed || ',')"
#: Token findings with their places; every match is 50 characters long, 9 of them before the secret.
_TOKENS = f"""
parts AS (
  SELECT doc_id, source, text, regexp_extract_all(text, {_quoted(TOKEN.pattern)}, 1) AS secrets,
         string_split_regex(text, 'token = "[0-9a-f]{{40}}"') AS gaps FROM documents),
found AS (SELECT *, unnest(range(1, len(secrets) + 1)) AS i FROM parts),
placed AS (
  SELECT doc_id, source, secrets[i] AS secret, '{TOKEN.id}' AS rule_id, source || '/doc-' || doc_id || '.txt' AS identity, upper(hex(secrets[i])) AS hexed,
         substr(text, 1, CAST(list_sum(list_transform(gaps[:i], lambda g: length(g))) + 50 * (i - 1) + 9 AS BIGINT)) AS prefix FROM found),
located AS (
  SELECT doc_id, rule_id, {_SQL_PATH} AS path, CAST(strlen(prefix) AS BIGINT) AS start, CAST(strlen(prefix) + 40 AS BIGINT) AS "end",
         CAST(length(prefix) - length(replace(prefix, chr(10), '')) + 1 AS BIGINT) AS line,
         CAST(strlen(list_last(string_split(prefix, chr(10)))) AS BIGINT) AS "column", {_FINGERPRINT} AS fingerprint FROM placed)"""


def keyword_gate(spark, sf):
    docs = _seeded(spark, sf).select(F.lower("text").alias("low"))
    counts = [F.count(F.when(detect.keyword_gate(F.col("low"), r), 1)).alias(r.id) for r in [*R.authored(), TOKEN]]
    wide = docs.agg(*counts)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.col(f"`{r.id}`").alias("documents")) for r in [*R.authored(), TOKEN]))).alias("x")).select("x.*")


def _gate_sql(r: R.Rule) -> str:
    test = " OR ".join(f"contains(lower(text), {_quoted(k)})" for k in r.keywords)
    return f"SELECT '{r.id}' AS rule_id, count(*) AS documents FROM seeded WHERE {test}"


#: The rules of a scan with every rule that is shipped, and the token rule.
_SHIPPED = [*R.authored(), *R.providers(), TOKEN]


def rule_dispatch(spark, sf):
    """Which rules each document is searched for: the automaton's answer for the keywords of all shipped rules."""
    views = F.array(fn.latin1(F.encode("text", "UTF-8")))
    ids = keywords.finder([r.keywords for r in _SHIPPED])(views)
    names = F.array(*(F.lit(r.id) for r in _SHIPPED))
    met = _seeded(spark, sf).select("doc_id", ids.alias("ids")).select("doc_id", F.explode(F.get("ids", F.lit(0))).alias("i"))
    return met.select("doc_id", F.get(names, F.col("i")).alias("rule_id"))


def _dispatch_sql() -> str:
    words = ", ".join(f"({_quoted(r.id)}, {_quoted(k.lower())})" for r in _SHIPPED for k in r.keywords)
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH seeded AS ({_SEEDED}), words(rule_id, word) AS (VALUES {words}),
low AS (SELECT doc_id, {low} AS low FROM seeded)
SELECT DISTINCT doc_id, rule_id FROM low JOIN words ON contains(low, word)"""


def regex_findings(spark, sf):
    return _scan(_docs(spark, sf), TOKENS_ONLY).select("doc_id", "rule_id", "path", "start", "end", "line", "column", "fingerprint")


def flagship(spark, sf):
    """The whole findings relation: authored rules and the token rule over documents with seeded lines."""
    return _scan(_seeded(spark, sf), scan.Config((TOKEN,)))


def line_column(spark, sf):
    return _scan(_docs(spark, sf), TOKENS_ONLY).select("doc_id", "start", "line", "column")


def pages_findings(spark, sf):
    rule = R.Rule("page-token", "Token in a page", "token = &quot;([0-9a-f]{40})&quot;", 1, ("token",))
    pages = scan.spread(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")).select("page_id", F.col("url").alias("path"), F.col("url").alias("identity"), F.encode("html", "UTF-8").alias("content"))
    found = scan.findings(pages, scan.Config((rule,), builtin=False, base64=False), secrets=True)
    return found.select("page_id", "path", F.sha2("secret", 256).alias("secret_sha256"))


def path_predicates(spark, sf):
    rule = R.Rule("by-path", "Token by path", TOKEN.pattern, 1, ("token",), path=r"^src\d*[02468]/", exclude_paths=(r"doc-\d*7\.txt$",), allowlist=(R.Allow(paths=(r"^src4/",)),))
    return _scan(_docs(spark, sf), scan.Config((rule,), builtin=False, base64=False)).select("doc_id", "path")


def secret_selection(spark, sf):
    whole = R.Rule("whole", "Whole match", r'token = "[0-9a-f]{40}"', 0, ("token",))
    first = R.Rule("first", "First capture", r'token = "([0-9a-f]{40})"', None, ("token",))
    return _secret_hash(_scan(_docs(spark, sf), scan.Config((whole, first), builtin=False, base64=False), secrets=True))


_ASSIGN = r'(?:password|access_token|api_key) = "([^"\n]{4,60})"'


def _assigned(spark, sf, **parts):
    rule = R.Rule("assigned", "Assigned literal", _ASSIGN, 1, ("password", "access_token", "api_key"), **parts)
    return _secret_hash(_scan(_seeded(spark, sf), scan.Config((rule,), builtin=False, base64=False), secrets=True))


_PLACEHOLDER_SQL = "lower(secret) IN (" + ", ".join(map(_quoted, fn.PLACEHOLDERS)) + ") OR (strlen(secret) >= 8 AND replace(secret, secret[1], '') = '')"
_ASSIGNED_SQL = f"""WITH seeded AS ({_SEEDED}),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, {_quoted(_ASSIGN)}, 1)) AS secret FROM seeded)
SELECT doc_id, 'assigned' AS rule_id, sha256(secret) AS secret_sha256 FROM found WHERE NOT ({_PLACEHOLDER_SQL})"""


def placeholder_filter(spark, sf):
    return _assigned(spark, sf)


def entropy_filter(spark, sf):
    return _assigned(spark, sf, min_entropy=3.3)


def entropy_values(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(fn.entropy(F.col("text")), 6).alias("bits"))


def allowlist_groups(spark, sf):
    allow = (R.Allow("and", "match", (r"password",), (), ("s3cr1",)), R.Allow("or", "line", (r"//", "KEY[0-9]*6")))
    return _assigned(spark, sf, allowlist=allow)


def prose_filter(spark, sf):
    rule = R.Rule("generic-credential-test", "Assigned literal", r'(?:auth_token|password) = "([^"\n]{4,90})"', 1, ("auth_token", "password"))
    return _secret_hash(_scan(_seeded(spark, sf), scan.Config((rule,), builtin=False, base64=False), secrets=True))


#: What goes before a contextual match's secret and behind it, by doc_id, next to the documents' own words.
_LEADS = "CASE doc_id % 4 WHEN 0 THEN 'api_key \"' WHEN 1 THEN '\" \"' WHEN 2 THEN 'key: ' ELSE '{\"key\": \"' END"
_TAILS = "CASE doc_id % 3 WHEN 0 THEN '\" : ' WHEN 1 THEN '\", x' ELSE '' END"


def non_value_filter(spark, sf):
    lead = F.concat(F.substring_index("text", ".", 1), F.lit(" "), F.expr(_LEADS))
    tail = F.concat(F.expr(_TAILS), F.substring_index("text", ".", -1))
    return _docs(spark, sf).select("doc_id", fn.is_non_value(lead, tail).alias("non_value"))


_TWO = (
    R.Rule("generic-a", "A", r'token = "([0-9a-f]{40})"', 1, ("token",), confidence="high"), R.Rule("provider-z", "Z", r'"([0-9a-f]{40})"', 1, ("token",)),
    R.Rule("provider-b", "B", r'= "([0-7][0-9a-f]{39})"', 1, ("token",), confidence="high"),
    R.Rule("provider-a", "PA", r'n = "([0-9a-f]{39}[a-f])"', 1, ("token",), confidence="high"),
    R.Rule("generic-half", "H", r'token = "([0-9a-f]{20})', 1, ("token",)),
)


def exact_span_merge(spark, sf):
    found = _scan(_docs(spark, sf), scan.Config(_TWO, builtin=False, base64=False))
    return found.select("doc_id", "start", "end", "rule_id", F.array_join("matched_rule_ids", ",").alias("matched"))


def primary_rule_rank(spark, sf):
    docs = _docs(spark, sf).withColumn("view", fn.latin1(F.encode("text", "UTF-8")))
    rows = docs.select("doc_id", F.explode(detect.all_candidates(F.col("view"), F.lower("view"), F.lit("p"), list(_TWO))).alias("c")).select("doc_id", "c.*")
    out = detect.merge_by_window(rows, ["doc_id"])
    return out.select("doc_id", "start", "end", "rule_id", F.array_join("matched", ",").alias("matched"))


def _coded(spark, sf):
    return _docs(spark, sf).withColumn("text", F.concat("text", F.lit("\n"), F.base64(F.encode(F.concat(F.lit('password = "inside-'), F.col("doc_id").cast("string"), F.lit('"')), "UTF-8")), F.lit(" .")))


_CODED = "SELECT doc_id, source, text || chr(10) || to_base64(encode('password = \"inside-' || doc_id || '\"')) || ' .' AS text FROM documents"


def base64_candidates(spark, sf):
    runs = scan.base64_runs(fn.latin1(F.encode("text", "UTF-8")))
    return _coded(spark, sf).select("doc_id", F.explode(runs).alias("m")).select("doc_id", F.col("m.match").alias("run"), F.length("m.match").cast("long").alias("size"))


def base64_findings(spark, sf):
    found = _scan(_coded(spark, sf), scan.Config(min_confidence="medium"), secrets=True).where("is_base64_encoded")
    return found.select("doc_id", "rule_id", "start", "end", "line", "column", F.sha2("secret", 256).alias("secret_sha256"))


def _authored(spark, sf, prefix):
    rules = tuple(r for r in R.authored() if r.id.startswith(prefix))
    return _secret_hash(_scan(_seeded(spark, sf), scan.Config(rules, builtin=False, base64=False), secrets=True))


def generic_assignments(spark, sf):
    return _authored(spark, sf, "generic-")


def uri_passwords(spark, sf):
    return _authored(spark, sf, "uri-")


def _authored_sql(prefix: str, seeded: str = _SEEDED, more: str = "true") -> str:
    """``more``: a further condition on doc_id and secret."""
    parts = []
    for r in R.authored():
        if r.id.startswith(prefix):
            allow = " OR ".join(f"regexp_matches(secret, {_quoted(x)})" for a in r.allowlist for x in a.regexes)
            token = "regexp_matches(lower(lead), '(api_?key|access_?token|auth_?token)[\"'']?[ \\t]*[:=]')"
            prose = f"{token} AND len(list_filter(string_split_regex(secret, '[ \\t]+'), lambda x: x <> '')) >= 8 AND regexp_matches(secret, '[,;.!?]([ \\t]|$)')" if prefix == "generic-" else "false"
            pairs = f"SELECT doc_id, unnest(regexp_extract_all(text, {_quoted(r.pattern)}, 1)) AS secret, unnest(regexp_extract_all(text, {_quoted(r.pattern)}, 0)) AS lead FROM seeded"
            parts.append(f"SELECT doc_id, '{r.id}' AS rule_id, sha256(secret) AS secret_sha256 FROM ({pairs}) WHERE secret <> '' AND NOT ({_PLACEHOLDER_SQL}) AND NOT ({allow}) AND NOT ({prose}) AND {more}")
    return f"WITH seeded AS ({seeded})\n" + "\nUNION ALL ".join(parts)


#: Rust code in front of the documents' texts, by doc_id % 4: two public fields, a macro's input, a private name.
_RUST = """CASE doc_id % 4
  WHEN 0 THEN 'struct S {' || chr(10) || '    pub access_token: Type' || doc_id || ',' || chr(10) || '}'
  WHEN 1 THEN '// pub' || chr(10) || 'struct T { pub(in crate::a) client_secret: Type' || doc_id || ', }'
  WHEN 2 THEN 'config! {' || chr(10) || '    pub access_token: Type' || doc_id || ',' || chr(10) || '}'
  ELSE 'let password: Type' || doc_id || ';' END || chr(10) || text"""


def rust_fields(spark, sf):
    """Findings of the rule for unquoted values in documents as Rust sources."""
    docs = _docs(spark, sf).withColumn("text", F.expr(_RUST))
    path = F.concat(F.lit("src/doc"), F.col("doc_id").cast("string"), F.lit(".rs"))
    inputs = docs.select("doc_id", path.alias("path"), path.alias("identity"), F.encode("text", "UTF-8").alias("content"))
    return _secret_hash(scan.findings(inputs, scan.Config((detect.TYPED,), builtin=False, base64=False), secrets=True))


def _split(spark, sf):
    found = regex_findings(spark, sf)
    old, now = found.where("doc_id % 3 <> 0"), found.where("doc_id % 3 <> 1")
    return now, baseline.from_findings(old, context={})


def baseline_new(spark, sf):
    now, old = _split(spark, sf)
    return baseline.new(now, old).select("doc_id", "fingerprint")


def baseline_resolved(spark, sf):
    now, old = _split(spark, sf)
    return baseline.resolved(now, old).select("fingerprint", F.col("finding.doc_id").alias("doc_id"))


def baseline_carry_forward(spark, sf):
    now, old = _split(spark, sf)
    marked = old.withColumn("disposition", F.concat(F.lit("seen in "), F.col("finding.doc_id").cast("string")))
    return baseline.from_findings(now, marked, context={}, previous_context={}).select("fingerprint", F.col("finding.doc_id").alias("doc_id"), "disposition")


def size_gate(spark, sf):
    inputs = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    kept, errors = scan.size_gate(inputs, 4000)
    return kept.select("path", F.lit("").alias("message")).unionByName(errors)


def scan_summary(spark, sf):
    docs = _docs(spark, sf)
    inputs = docs.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id", "text", "source")
    limit = scan.Config().max_bytes
    kept, errors = scan.size_gate(inputs, limit)
    counted = report.stats(inputs.select(F.octet_length("content").cast("long").alias("length")), limit)
    return report.summary(_scan(kept.select("doc_id", "text", "source"), TOKENS_ONLY), errors).crossJoin(counted)  # one row each


def rule_inventory(spark, sf):
    """The rules of a scan, one of them overridden, and how many documents each is searched in."""
    rules = R.inventory(spark, R.override(_SHIPPED, [R.Rule("github-pat", "Overridden", "x(y)", 1)]))
    searched = rule_dispatch(spark, sf).groupBy("rule_id").agg(F.count("*").alias("documents"))
    named = rules.join(searched, rules["id"] == searched["rule_id"], "left").drop("rule_id")
    return named.withColumn("documents", F.coalesce("documents", F.lit(0)))


def git_occurrences(spark, sf):
    """Findings of documents, each a blob, placed in the commits of orders: the joins of a history, on a table of any size."""
    from sieveline.sources import git

    orders, docs = spark.read.parquet(f"{sf}/orders.parquet"), _docs(spark, sf)
    log = orders.select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("tree"))
    trees = orders.select(F.col("o_custkey").alias("tree")).distinct()
    blobs = docs.select(F.col("doc_id").alias("oid"), _path().alias("path"))
    entries = trees.withColumn("oid", F.col("tree") % F.lit(docs.count())).join(blobs, "oid")
    found = _scan(docs, TOKENS_ONLY).withColumnRenamed("doc_id", "oid")
    return git.occurrences(found, entries, log).select("commit", "path", "rule_id", "line", "fingerprint")


def _scored(spark, sf):
    """Findings, shifted by up to 30 of their 40 bytes, and their spans as labels."""
    found = regex_findings(spark, sf).withColumn("finding_id", F.xxhash64("path", "start"))
    shifted = found.select("finding_id", "path", (F.col("start") - F.col("doc_id") % 4 * 10).alias("start"), (F.col("end") - F.col("doc_id") % 4 * 10).alias("end"))
    label = F.when(F.col("doc_id") % 5 == 0, "negative").otherwise("positive").alias("label")
    return shifted, found.select(F.col("finding_id").alias("label_id"), "path", "start", "end", label, F.split_part("path", F.lit("/"), F.lit(1)).alias("provider"))


def quality_confusion(spark, sf):
    return quality.confusion(*_scored(spark, sf))


def quality_by_provider(spark, sf):
    return quality.recall_by(*_scored(spark, sf), "provider")


def preview_topk(spark, sf):
    found = regex_findings(spark, sf)
    return report.preview(found.drop("doc_id"), rows=10).select("place", F.get_json_object("finding", "$.path").alias("path"), F.get_json_object("finding", "$.start").cast("long").alias("start"))


def sarif_results(spark, sf):
    return report.sarif_results(_scan(_docs(spark, sf), TOKENS_ONLY)).select("path", "start", F.get_json_object("result", "$.ruleId").alias("rule"), F.get_json_object("result", "$.locations[0].physicalLocation.region.startLine").cast("long").alias("line"), F.get_json_object("result", "$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"))


def sarif_rules(spark, sf):
    return report.sarif_rules(_scan(_docs(spark, sf), TOKENS_ONLY))


def path_uris(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "/").otherwise(""), F.col("page_id").cast("string"), F.lit(" a~b*c+é/"), F.lit("x.y"))
    return pages.select("page_id", fn.path_uri(path).alias("uri"))


def logical_identities(spark, sf):
    return _docs(spark, sf).select("doc_id", fn.logical_identity(F.concat(F.lit("./"), _path())).alias("identity"))


def archive_names(spark, sf):
    docs = _docs(spark, sf)
    name = F.concat(F.lit("dir/f"), F.col("doc_id").cast("string"), F.expr("CASE doc_id % 4 WHEN 0 THEN '.tgz' WHEN 1 THEN '.GZ' WHEN 2 THEN '.zip' ELSE '.txt' END"))
    data = F.expr("CASE doc_id % 5 WHEN 0 THEN X'504B0304' WHEN 1 THEN X'1F8B08' ELSE X'00' END")
    return docs.select("doc_id", fn.archive_format(name, data).alias("format"), fn.gzip_member(name).alias("member"))


def progress_throttle(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    times = events.select(F.col("user_id").cast("long").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ms"))
    return report.throttle_counts(times, 3_600_000).select(F.col("key").alias("user_id"), "kept")


def archive_expand(spark, sf):
    """Gzip and ZIP files made from documents, expanded and scanned."""
    import gzip
    import io
    import zipfile

    from sieveline.sources import archives

    def packed(frames):
        for pdf in frames:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                data = (text or "").encode()
                if i % 2:
                    out.append(gzip.compress(data, mtime=0))
                else:
                    sink = io.BytesIO()
                    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr("a.txt", data)
                    out.append(sink.getvalue())
            names = [f"d{i}.gz" if i % 2 else f"d{i}.zip" for i in pdf["doc_id"]]
            yield pdf.assign(path=names, identity=names, content=out)[["path", "identity", "content"]]

    inputs = _docs(spark, sf).select("doc_id", "text").mapInPandas(packed, "path string, identity string, content binary")
    members = archives.expand(inputs).where("error is null").select("path", "identity", "content")
    return scan.findings(members, TOKENS_ONLY, space="archive_member_bytes").select("path", "rule_id", "start", "end", "line", "coordinate_space")


def archive_parts(spark, sf):
    """The members of archives that are cut into parts and opened by several tasks: each text is a ZIP or tar of its pieces of 2,000 characters."""
    import io
    import tarfile
    import zipfile

    from sieveline.sources import archives

    def packed(frames):
        for pdf in frames:
            names, contents = [], []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                pieces = [(text or "")[at : at + 2000].encode() for at in range(0, len(text or ""), 2000)]
                sink = io.BytesIO()
                if i % 2:
                    with tarfile.open(fileobj=sink, mode="w") as t:
                        for n, piece in enumerate(pieces):
                            own = tarfile.TarInfo(f"p{n}")
                            own.size = len(piece)
                            t.addfile(own, io.BytesIO(piece))
                else:
                    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
                        for n, piece in enumerate(pieces):
                            z.writestr(f"p{n}", piece)
                names.append(f"d{i}.tar" if i % 2 else f"d{i}.zip")
                contents.append(sink.getvalue())
            yield pdf.assign(path=names, identity=names, content=contents)[["path", "identity", "content"]]

    inputs = _docs(spark, sf).select("doc_id", "text").mapInPandas(packed, "path string, identity string, content binary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = archives.expand(inputs, spread=tasks, part=16 << 10)
    return members.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("content_sha256"), "error")


def stream_scan(spark, sf):
    """A stream of documents scanned in micro-batches into a table."""
    import tempfile
    import uuid

    from sieveline.streaming import scan as streaming

    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-stream-")
    place = f"{place}/stream-{uuid.uuid4().hex[:12]}"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf}/documents.[p]arquet").select("doc_id", _path().alias("path"), fn.logical_identity(_path()).alias("identity"), F.encode("text", "UTF-8").alias("content"))
    query = streaming.start(docs, lambda rows, batch: rows.drop("matched_rule_ids").write.mode("overwrite").parquet(f"{place}/findings/batch={batch}"), f"{place}/state", TOKENS_ONLY)
    query.awaitTermination()
    return spark.read.parquet(f"{place}/findings").select("doc_id", "rule_id", "path", "start", "end", "line", "column", "fingerprint")


def _utf16(spark, sf):
    docs = _docs(spark, sf)
    body = F.encode("text", "UTF-16LE")
    broken = F.expr("doc_id % 10 = 3")
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("doc_id").cast("string").alias("identity"), F.concat(F.lit(b"\xff\xfe"), body, F.when(broken, F.lit(b"\x00")).otherwise(F.lit(b""))).alias("content"))


def utf16_findings(spark, sf):
    from sieveline.sources import encodings

    good, errors = encodings.decode_utf16(_utf16(spark, sf))
    found = scan.findings(good, TOKENS_ONLY, secrets=True).select("doc_id", "start", "end", "line", "column", F.sha2("secret", 256).alias("secret_sha256"))
    return found.unionByName(errors.select(F.col("path").cast("long").alias("doc_id"), F.col("message").alias("secret_sha256")), allowMissingColumns=True).fillna(-1)


QUERIES = {
    f.__name__: f
    for f in (
        keyword_gate, rule_dispatch, regex_findings, line_column, pages_findings, path_predicates, secret_selection, placeholder_filter, entropy_filter, entropy_values, allowlist_groups, prose_filter, non_value_filter,
        rust_fields, exact_span_merge, primary_rule_rank, base64_candidates, base64_findings, generic_assignments, uri_passwords, baseline_new, baseline_resolved, baseline_carry_forward, size_gate, scan_summary, rule_inventory,
        git_occurrences, quality_confusion, quality_by_provider, preview_topk, sarif_results, sarif_rules, path_uris, logical_identities, archive_names, progress_throttle, archive_expand, archive_parts, stream_scan, utf16_findings,
    )
}

_SIMPLE_TOKEN = _quoted(TOKEN.pattern)
#: Which rules meet in a span depends on the token's first and last digit; half a token is a span of its own.
_MERGED = """SELECT l.doc_id, l.start, l."end", CASE WHEN p.last THEN 'provider-a' WHEN p.first THEN 'provider-b' ELSE 'provider-z' END AS rule_id,
  'generic-a' || CASE WHEN p.last THEN ',provider-a' ELSE '' END || CASE WHEN p.first THEN ',provider-b' ELSE '' END || ',provider-z' AS matched
FROM located l JOIN (SELECT doc_id, strlen(prefix) AS start, regexp_matches(secret, '^[0-7]') AS first, regexp_matches(secret, '[a-f]$') AS last FROM placed) p
  ON l.doc_id = p.doc_id AND l.start = p.start
UNION ALL SELECT doc_id, start, start + 20, 'generic-half', NULL FROM located"""
#: Entropy of a string in SQL.
_BITS = "list_sum(list_transform(list_distinct(string_split(s, '')), lambda c: -(length(s) - length(replace(s, c, ''))) / length(s) * log2((length(s) - length(replace(s, c, ''))) / length(s))))"

#: UTF-16 units of a string in SQL.
_UNITS = "(2 * length({0}) - length(regexp_replace({0}, '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"

#: Findings of _scored with the labels that they meet, and their classes.
_SCORED = f"""{_TOKENS},
labels AS (SELECT path, start AS l, "end" AS r, doc_id % 5 <> 0 AS positive FROM located),
shown AS (SELECT path, start AS id, start - doc_id % 4 * 10 AS s, "end" - doc_id % 4 * 10 AS e FROM located),
pairs AS (
  SELECT f.path, f.id, f.s, f.e, g.l, g.positive, coalesce(f.s = g.l AND f.e = g.r, false) AS exact, coalesce(least(f.e, g.r) - greatest(f.s, g.l), 0) AS shared
  FROM shown f LEFT JOIN labels g ON f.path = g.path),
met AS (SELECT *, exact OR (NOT bool_or(exact) OVER (PARTITION BY path, id) AND shared >= 20) AS hit FROM pairs),
each AS (
  SELECT path, id, s, e, count(*) FILTER (hit) AS hits, bool_or(shared > 0) AS touches, min(l) FILTER (hit) AS label, coalesce(bool_or(positive) FILTER (hit), false) AS good
  FROM met GROUP BY path, id, s, e),
classed AS (
  SELECT *, CASE WHEN hits > 1 OR (hits = 0 AND touches) THEN 'unlocalized'
    WHEN row_number() OVER (PARTITION BY hits > 1 OR (hits = 0 AND touches), path, hits, CASE WHEN hits = 1 THEN label ELSE s END ORDER BY id) > 1 THEN 'duplicate'
    WHEN good THEN 'tp' ELSE 'fp' END AS class FROM each)"""
_NEGATIVES = """flagged AS (SELECT DISTINCT path, label AS l FROM classed WHERE class = 'fp' AND hits = 1),
meant AS (
  SELECT DISTINCT m.path, m.l FROM classed c JOIN met m ON c.path = m.path AND c.id = m.id WHERE c.class = 'unlocalized' AND NOT m.positive AND (c.hits = 0 OR m.hit)
  EXCEPT SELECT path, l FROM flagged)"""

ORACLES = {
    "quality_confusion": f"""WITH {_SCORED}, {_NEGATIVES}, n AS (
  SELECT count(*) FILTER (class = 'tp') AS tp, count(*) FILTER (class = 'fp') AS fp, count(*) FILTER (class = 'unlocalized') AS unlocalized,
         count(*) FILTER (class = 'duplicate') AS duplicates, (SELECT count(*) FROM labels WHERE positive) AS p, (SELECT count(*) FROM labels WHERE NOT positive) AS q,
         (SELECT count(*) FROM flagged) AS negative_labels_flagged, (SELECT count(*) FROM meant) AS negative_labels_unresolved FROM classed),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN p > 0 THEN tp / p END AS recall FROM n)
SELECT tp, fp, p - tp AS fn, q - negative_labels_flagged - negative_labels_unresolved AS tn, unlocalized, duplicates, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) WHEN p > 0 THEN 0.0 END AS f1,
  negative_labels_flagged, negative_labels_unresolved FROM r""",
    "quality_by_provider": f"""WITH {_SCORED}, hits AS (SELECT DISTINCT path, label AS seen FROM classed WHERE class = 'tp')
SELECT split_part(labels.path, '/', 1) AS provider, count(*) AS total, count(seen) AS tp, count(seen) / count(*) AS recall
FROM labels LEFT JOIN hits ON labels.path = hits.path AND l = seen WHERE positive GROUP BY 1""",
    "keyword_gate": f"WITH seeded AS ({_SEEDED})\n" + "\nUNION ALL ".join(_gate_sql(r) for r in [*R.authored(), TOKEN]),
    "rule_dispatch": _dispatch_sql(),
    "regex_findings": f"WITH {_TOKENS} SELECT * FROM located",
    "stream_scan": f"WITH {_TOKENS} SELECT * FROM located",
    "line_column": f'WITH {_TOKENS} SELECT doc_id, start, line, "column" FROM located',
    "pages_findings": "SELECT page_id, url AS path, sha256(unnest(regexp_extract_all(html, 'token = &quot;([0-9a-f]{40})&quot;', 1))) AS secret_sha256 FROM pages",
    "path_predicates": f"WITH {_TOKENS} SELECT doc_id, path FROM located WHERE regexp_matches(path, '^src\\d*[02468]/') AND NOT regexp_matches(path, 'doc-\\d*7\\.txt$') AND NOT regexp_matches(path, '^src4/')",
    "secret_selection": f"SELECT doc_id, 'first' AS rule_id, sha256(unnest(regexp_extract_all(text, {_SIMPLE_TOKEN}, 1))) AS secret_sha256 FROM documents UNION ALL SELECT doc_id, 'whole', sha256(unnest(regexp_extract_all(text, {_SIMPLE_TOKEN}, 0))) FROM documents",
    "placeholder_filter": _ASSIGNED_SQL,
    "entropy_filter": _ASSIGNED_SQL + f" AND (SELECT {_BITS} FROM (SELECT secret AS s)) > 3.3",
    "entropy_values": f"SELECT doc_id, round(CASE WHEN s = '' THEN 0.0 ELSE {_BITS} END, 6) AS bits FROM (SELECT doc_id, text AS s FROM documents)",
    "allowlist_groups": f"""WITH seeded AS ({_SEEDED}),
found AS (SELECT doc_id, list_last(string_split(text, chr(10))) AS line, regexp_extract_all(text, {_quoted(_ASSIGN)}, 1) AS secrets, regexp_extract_all(text, {_quoted(_ASSIGN)}, 0) AS matches FROM seeded),
each AS (SELECT doc_id, line, unnest(secrets) AS secret, unnest(matches) AS matched FROM found)
SELECT doc_id, 'assigned' AS rule_id, sha256(secret) AS secret_sha256 FROM each
WHERE NOT ({_PLACEHOLDER_SQL}) AND NOT (contains(matched, 'password') AND contains(lower(secret), 's3cr1')) AND NOT (regexp_matches(line, '//') OR regexp_matches(line, 'KEY[0-9]*6'))""",
    "prose_filter": f"""WITH seeded AS ({_SEEDED}),
each AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:auth_token|password) = "([^"\\n]{{4,90}})"', 1)) AS secret, unnest(regexp_extract_all(text, '(?:auth_token|password) = "([^"\\n]{{4,90}})"', 0)) AS matched FROM seeded)
SELECT doc_id, 'generic-credential-test' AS rule_id, sha256(secret) AS secret_sha256 FROM each
WHERE NOT ({_PLACEHOLDER_SQL}) AND NOT (starts_with(matched, 'auth_token') AND len(string_split(secret, ' ')) >= 8 AND regexp_matches(secret, '[,;.!?]( |$)'))""",
    "non_value_filter": f"""WITH cut AS (
  SELECT doc_id, regexp_replace(split_part(text, '.', 1) || ' ' || {_LEADS}, '[ \\t\\n\\f\\r]+$', '') AS lead, {_TAILS} || list_last(string_split(text, '.')) AS tail FROM documents),
parts AS (SELECT doc_id, lead, tail, lead[-1] AS mark, regexp_replace(split_part(lead, ',', 1), '[ \\t\\n\\f\\r]+$', '')[-1] AS before FROM cut)
SELECT doc_id, (mark IN ('"', '''') AND starts_with(tail, mark) AND regexp_matches(tail[2:], '^[ \\t\\n\\f\\r]*:'))
  OR (contains(lead, ',') AND NOT (mark IN ('"', '''') AND before IN ('"', ''''))) AS non_value FROM parts""",
    "rust_fields": _authored_sql("generic-credential-unquoted", f"SELECT doc_id, {_RUST} AS text FROM documents", "NOT (doc_id % 4 < 2 AND secret = 'Type' || doc_id)"),
    "exact_span_merge": f"WITH {_TOKENS} {_MERGED}",
    "primary_rule_rank": f"WITH {_TOKENS} {_MERGED}",
    "base64_candidates": f"SELECT doc_id, run, CAST(strlen(run) AS BIGINT) AS size FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_-]{{24,}}={{0,2}}')) AS run FROM ({_CODED}))",
    "base64_findings": """SELECT doc_id, 'generic-credential-double' AS rule_id, CAST(strlen(text) + 1 AS BIGINT) AS start,
  CAST(strlen(text) + 1 + strlen(to_base64(encode('password = "inside-' || doc_id || '"'))) AS BIGINT) AS "end",
  CAST(length(text) - length(replace(text, chr(10), '')) + 2 AS BIGINT) AS line, CAST(0 AS BIGINT) AS "column", sha256('inside-' || doc_id) AS secret_sha256 FROM documents""",
    "generic_assignments": _authored_sql("generic-"),
    "uri_passwords": _authored_sql("uri-"),
    "baseline_new": f"WITH {_TOKENS} SELECT doc_id, fingerprint FROM located WHERE doc_id % 3 <> 1 AND fingerprint NOT IN (SELECT fingerprint FROM located WHERE doc_id % 3 <> 0)",
    "baseline_resolved": f"WITH {_TOKENS} SELECT fingerprint, min(doc_id) AS doc_id FROM located WHERE doc_id % 3 <> 0 AND fingerprint NOT IN (SELECT fingerprint FROM located WHERE doc_id % 3 <> 1) GROUP BY fingerprint",
    "baseline_carry_forward": f"WITH {_TOKENS} SELECT fingerprint, min(doc_id) AS doc_id, CASE WHEN min(doc_id) % 3 <> 0 THEN 'seen in ' || min(doc_id) END AS disposition FROM located WHERE doc_id % 3 <> 1 GROUP BY fingerprint",
    "size_gate": "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN strlen(text) > 4000 THEN 'input exceeds 4000 byte limit' ELSE '' END AS message FROM documents",
    "scan_summary": f"""WITH {_TOKENS}, kept AS (SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE strlen(text) <= 67108864),
over AS (SELECT count(*) AS skipped FROM documents WHERE strlen(text) > 67108864),
n AS (SELECT count(*) AS finding_count FROM located JOIN documents USING (doc_id) WHERE strlen(text) <= 67108864)
SELECT finding_count, skipped AS error_count, skipped = 0 AS complete, CASE WHEN skipped > 0 THEN 2 WHEN finding_count > 0 THEN 1 ELSE 0 END AS exit_code, files, bytes, skipped, files AS detection_passes FROM n, kept, over""",
    "rule_inventory": f"""WITH met AS ({_dispatch_sql()}), n AS (SELECT rule_id, count(*) AS documents FROM met GROUP BY rule_id)
SELECT t.*, coalesce(documents, 0) AS documents FROM (VALUES
('corpus-token-assignment', 'Token assigned in text', 'medium'),
('generic-credential-double', 'Literal assigned to a credential key', 'medium'),
('generic-credential-single', 'Literal assigned to a credential key', 'medium'),
('generic-credential-unquoted', 'Literal assigned to a credential key', 'medium'),
('github-pat', 'Overridden', 'medium'),
('uri-userinfo-password', 'Password in URI authority userinfo', 'medium'),
('airtable-pat', 'Airtable personal access token', 'high'),
('anthropic-api-key', 'Anthropic API key', 'high'),
('aws-access-key-id', 'AWS access key id', 'high'),
('databricks-api-token', 'Databricks API token', 'high'),
('digitalocean-pat', 'DigitalOcean personal access token', 'high'),
('doppler-api-token', 'Doppler API token', 'high'),
('flyio-access-token', 'Fly.io access token', 'high'),
('gitlab-pat', 'GitLab personal access token', 'high'),
('google-api-key', 'Google API key', 'high'),
('huggingface-token', 'Hugging Face token', 'high'),
('linear-api-key', 'Linear API key', 'high'),
('npm-access-token', 'npm access token', 'high'),
('planetscale-api-token', 'PlanetScale API token', 'high'),
('postman-api-token', 'Postman API token', 'high'),
('pulumi-api-token', 'Pulumi API token', 'high'),
('sendgrid-api-key', 'SendGrid API key', 'high'),
('shopify-access-token', 'Shopify access token', 'high'),
('slack-bot-token', 'Slack bot token', 'high'),
('stripe-secret-key', 'Stripe secret key', 'high'),
('twilio-api-key', 'Twilio API key', 'high')) t(id, name, confidence) LEFT JOIN n ON rule_id = id""",
    "git_occurrences": f"""WITH {_TOKENS} SELECT o_orderkey AS commit, 'git:' || o_orderkey || ':' || path AS path, rule_id, line, fingerprint
FROM orders JOIN located ON doc_id = o_custkey % (SELECT count(*) FROM documents)""",
    "preview_topk": f"WITH {_TOKENS} SELECT row_number() OVER (ORDER BY path, start) - 1 AS place, path, start FROM located ORDER BY path, start LIMIT 10",
    "sarif_results": f"WITH {_TOKENS} SELECT path, start, rule_id AS rule, line, path AS uri FROM located",
    "sarif_rules": f"WITH {_TOKENS} SELECT DISTINCT rule_id, 'Matched {TOKEN.name} (medium confidence); not live-validated' AS text FROM located",
    "path_uris": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'file:///' ELSE '' END || page_id || '%20a~b%2Ac%2B%C3%A9/x.y' AS uri FROM pages",
    "logical_identities": "SELECT doc_id, source || '/doc-' || doc_id || '.txt' AS identity FROM documents",
    "archive_names": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 4 = 2 THEN 'zip' WHEN doc_id % 5 = 1 OR doc_id % 4 IN (0, 1) THEN 'gzip' END AS format,
CASE doc_id % 4 WHEN 0 THEN 'f' || doc_id || '.tar' WHEN 1 THEN 'f' || doc_id ELSE 'content' END AS member FROM documents""",
    "archive_expand": f"""WITH {_TOKENS} SELECT CASE WHEN doc_id % 2 = 1 THEN 'd' || doc_id || '.gz!d' || doc_id ELSE 'd' || doc_id || '.zip!a.txt' END AS path, rule_id, start, "end", line, 'archive_member_bytes' AS coordinate_space FROM located""",
    "archive_parts": """WITH pieces AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 2000.0) AS BIGINT))) AS n FROM documents),
cut AS (SELECT doc_id, n, substr(text, CAST(n * 2000 + 1 AS BIGINT), 2000) AS piece FROM pieces)
SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 1 THEN '.tar' ELSE '.zip' END || '!p' || n AS path, strlen(piece) AS bytes, sha256(piece) AS content_sha256, CAST(NULL AS VARCHAR) AS error FROM cut""",
    "progress_throttle": """WITH RECURSIVE times AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id, epoch_ms(CAST(ts AS TIMESTAMP)) AS ms FROM events),
kept AS (
  SELECT user_id, min(ms) AS ms FROM times GROUP BY user_id
  UNION ALL
  SELECT k.user_id, min(t.ms) FROM kept k JOIN times t ON t.user_id = k.user_id AND t.ms >= k.ms + 3600000 GROUP BY k.user_id)
SELECT user_id, count(*) AS kept FROM kept GROUP BY user_id""",
    "utf16_findings": f"""WITH {_TOKENS},
units AS (SELECT doc_id, secret, prefix, {_UNITS.format('prefix')} AS n, {_UNITS.format("list_last(string_split(prefix, chr(10)))")} AS own FROM placed WHERE doc_id % 10 <> 3)
SELECT doc_id, CAST(2 + 2 * n AS BIGINT) AS start, CAST(82 + 2 * n AS BIGINT) AS "end", CAST(length(prefix) - length(replace(prefix, chr(10), '')) + 1 AS BIGINT) AS line,
  CAST(2 * own + CASE WHEN contains(prefix, chr(10)) THEN 0 ELSE 2 END AS BIGINT) AS "column", sha256(secret) AS secret_sha256 FROM units
UNION ALL SELECT doc_id, -1, -1, -1, -1, 'invalid UTF-16 content' FROM documents WHERE doc_id % 10 = 3""",
}
