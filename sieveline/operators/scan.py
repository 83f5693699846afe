"""Scanning a table of contents: views, detection, coordinates, fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import rust
from sieveline.functions import text as fn
from sieveline.operators import detect
from sieveline.plans import rules as R
from sieveline.sources import encodings

BASE64_RUN = r"[A-Za-z0-9+/_-]{24,}={0,2}"
FINDING = (
    "rule_id string, matched_rule_ids array<string>, path string, start bigint, end bigint, line bigint, column bigint, redacted string, fingerprint string, explanation string, "
    "confidence string, is_base64_encoded boolean, coordinate_space string"
)
COLUMNS = [x.split()[0] for x in FINDING.replace("array<string>", "a").split(", ")]


@dataclass(frozen=True)
class Config:
    """What a scan looks for and how."""

    rules: tuple[R.Rule, ...] = ()
    builtin: bool = True
    min_confidence: str = "low"
    min_entropy: float | None = None
    base64: bool = True
    fingerprint_key: str | None = None
    max_bytes: int = 64 << 20
    providers: bool = False

    def compiled(self) -> list[R.Rule]:
        R.check_entropy(self.min_entropy)
        shipped = (R.authored() if self.builtin else []) + (R.providers() if self.providers else [])
        chosen = R.select(R.override(shipped, list(self.rules)), self.min_confidence)
        R.check(chosen)
        return chosen


def base64_runs(view: Column) -> Column:
    """Runs that may be Base64: array of (mstart, match, ...) as detect.placed gives them."""
    return detect.native_matches(view, BASE64_RUN, 0)


def decode_base64(run: Column) -> Column:
    """The bytes of a whole run as a Latin-1 string, or null. One alphabet per run; padding is whole or absent, and unused bits are zero."""
    url = run.rlike("[-_]")
    plain = F.when(~(url & run.rlike("[+/]")), F.translate(run, "-_", "+/"))
    body = F.regexp_replace(plain, "=+$", "")
    padded = F.rpad(body, ((F.length(body) + 3) / 4).cast("int") * 4, "=")
    fits = (plain == body) | (plain == padded)
    data = F.try_to_binary(F.when(fits & (F.length(body) % 4 != 1), padded), F.lit("base64"))
    return F.when(F.replace(F.base64(data), F.lit("\r\n"), F.lit("")) == padded, fn.latin1(data))


_VIEW = "struct<view: string, base64: boolean, box_start: bigint, box_end: bigint>"


def views(raw: Column, base64: bool = True) -> Column:
    """The views of a content: itself first, then what each run that decodes as Base64 holds, with the run's place in the raw view."""

    def view(content: Column, coded: bool, start: Column, end: Column) -> Column:
        return F.struct(content.alias("view"), F.lit(coded).alias("base64"), start.cast("bigint").alias("box_start"), end.cast("bigint").alias("box_end"))

    def decoded(m: Column) -> Column:
        return view(decode_base64(m["match"]), True, m["mstart"], m["mstart"] + F.length(m["match"]))

    own = F.array(view(raw, False, F.lit(None), F.lit(None)))
    if not base64:
        return own
    # A cheap necessary condition first; most contents hold no such run.
    runs = F.when(raw.rlike("[A-Za-z0-9+/_-]{24}"), F.filter(F.transform(base64_runs(raw), decoded), lambda x: x["view"].isNotNull()))
    return F.concat(own, F.coalesce(runs, F.array().cast(f"array<{_VIEW}>")))


def findings(inputs: DataFrame, config: Config | None = None, space: str | Column = "source_bytes", secrets: bool = False) -> DataFrame:
    """Findings in inputs (path, identity, content): one row each, without the secret unless ``secrets`` is asked for by a test.

    If inputs have a column ``error``, a row with one becomes a row with its path and error and no finding; see ``parted``.

    Where a column ``utf16`` (see encodings.decode_utf16) is true, the content is decoded text and places are those in its UTF-16 source. All views
    of an input stay in its row, and the places of all its findings are worked out at once, so neither many runs nor many findings copy it.
    """
    config = config or Config()
    rules = config.compiled()
    names = F.create_map(*(F.lit(x) for r in rules for x in (r.id, r.name)))
    levels = F.create_map(*(F.lit(x) for r in rules for x in (r.id, r.confidence)))
    extra = [c for c in inputs.columns if c not in ("content", "utf16")]
    failed = F.col("error").isNotNull() if "error" in extra else F.lit(False)
    where = F.lit(space) if isinstance(space, str) else space
    decoded = F.coalesce(F.col("utf16"), F.lit(False)) if "utf16" in inputs.columns else F.lit(False)
    seen = inputs.select(*extra, where.alias("_space"), decoded.alias("_utf16"), views(fn.latin1(F.col("content")), config.base64).alias("_views"))
    kernel = detect.Rules(rules, config.min_entropy)
    ids, by_python = kernel.found(F.transform("_views", lambda v: v["view"]), F.col("path"))
    seen = seen.withColumns({"_ids": ids} | ({} if by_python is None else {"_python": by_python}))

    def searched(v: Column, i: Column) -> Column:
        own = kernel.candidates(v["view"], F.get("_ids", i), None if by_python is None else F.get("_python", i), F.col("path"))
        return F.struct(own.alias("own"), v["base64"].alias("base64"), v["box_start"].alias("box_start"), v["box_end"].alias("box_end"))

    # Exploding a list of one list or none drops the inputs without findings, with the list worked out once.
    per_view = F.filter(F.transform("_views", searched), lambda x: F.size(x["own"]) > 0)
    some = lambda found: F.explode(fn.let(found, lambda f: F.when((F.size(f) > 0) | failed, F.array(f)).otherwise(F.slice(F.array(f), 1, 0))))
    hits = seen.select(*extra, "_space", "_utf16", F.get("_views", F.lit(0))["view"].alias("_raw"), some(per_view).alias("_met"))
    if kernel.typed:
        # Of what is left, matches in raw Rust sources whose colon introduces a type go.
        asked = F.flatten(F.transform(F.filter("_met", lambda x: ~x["base64"]), lambda x: F.filter(F.transform(x["own"], lambda c: c["field_at"]), lambda n: n.isNotNull())))
        hits = hits.withColumn("_asked", F.when(F.endswith("path", F.lit(".rs")), asked)).withColumn("_fields", rust.fields()("_raw", "_asked"))

    def merged(x: Column) -> Column:
        own = x["own"]
        if kernel.typed:
            own = F.filter(own, lambda c: x["base64"] | c["field_at"].isNull() | ~F.array_contains(F.col("_fields"), c["field_at"]))
        place = lambda f: F.struct(
            F.coalesce(x["box_start"], f["start"]).alias("start"), F.coalesce(x["box_end"], f["end"]).alias("end"),
            f["rule_id"].alias("rule_id"), f["matched"].alias("matched"), f["secret"].alias("secret"), x["base64"].alias("base64"),
        )
        return F.transform(detect.merge(own, len(rules)), place)

    hits = hits.select(*extra, "_space", "_utf16", "_raw", some(F.flatten(F.transform("_met", merged))).alias("_found"))
    at = encodings.places("_raw", F.transform("_found", lambda f: f["start"]), F.transform("_found", lambda f: f["end"]), "_utf16")
    each = hits.withColumn("_at", at).select(*extra, "_space", "_utf16", F.explode_outer(F.zip_with("_found", "_at", lambda f, x: F.struct(f.alias("f"), x.alias("at")))).alias("_one"))
    each = each.where(F.col("_one").isNotNull() | failed)
    f, place = F.col("_one.f"), F.col("_one.at")
    out = each.select(
        *(c for c in extra if c not in ("path", "identity")),
        f["rule_id"].alias("rule_id"),
        f["matched"].alias("matched_rule_ids"),
        "path",
        *(place[c].alias(c) for c in ("start", "end", "line", "column")),
        F.lit(fn.REDACTED).alias("redacted"),
        fn.fingerprint(f["rule_id"], F.col("identity"), F.hex(F.encode(f["secret"], "ISO-8859-1")), config.fingerprint_key).alias("fingerprint"),
        fn.explanation(names[f["rule_id"]], levels[f["rule_id"]], f["base64"], F.col("_utf16")).alias("explanation"),
        levels[f["rule_id"]].alias("confidence"),
        f["base64"].alias("is_base64_encoded"),
        F.col("_space").alias("coordinate_space"),
        *([f["secret"].alias("secret")] if secrets else []),
    )
    return out


def parted(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``findings`` gives for inputs with a column ``error``: (findings, errors path and message)."""
    return found.where("error is null").drop("error"), found.where("error is not null").select("path", F.col("error").alias("message"))


def scan_column(
    df: DataFrame, path: Column, content: Column, config: Config | None = None, identity: Column | None = None, keep: tuple[str, ...] = (), errors: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Findings in a text or binary column of a table; columns in ``keep`` are carried along.

    UTF-16 contents with a byte order mark are decoded. With ``errors`` a pair is given: findings, and error rows (path, message) of malformed
    ones; without, a malformed one fails the job, so that none is passed over in silence.
    """
    own = fn.logical_identity(identity if identity is not None else path)
    good, bad = encodings.decode_utf16(df.select(*keep, path.alias("path"), own.alias("identity"), content.cast("binary").alias("content")), strict=not errors)
    return (findings(good, config), bad) if errors else findings(good, config)


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt out over all cores if its files give fewer splits than there are cores; a table of many splits stays where it is.

    Searching costs far more than moving a few large splits once. For plain reads: counting the splits of a plan with shuffles would run it.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(2 * cores) if table.rdd.getNumPartitions() < cores else table


def size_gate(inputs: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Inputs within the limit, and error rows (path, message) for the others."""
    over = F.octet_length("content") > max_bytes
    errors = inputs.where(over).select("path", F.lit(f"input exceeds {max_bytes} byte limit").alias("message"))
    return inputs.where(~over | F.col("content").isNull()), errors
