"""Detection rules: their schema, loading, overriding, checking, and the authored ones."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CONFIDENCE = {"low": 0, "medium": 1, "high": 2}
RULE_SCHEMA = (
    "id string, name string, pattern string, secret_group int, keywords array<string>, min_entropy double, confidence string, path string, "
    "allowlist array<struct<condition: string, target: string, regexes: array<string>, paths: array<string>, stopwords: array<string>>>, exclude_paths array<string>"
)


class RuleError(ValueError):
    """A rule that cannot be used. Messages name the rule, never its pattern."""


@dataclass(frozen=True)
class Allow:
    """Findings to leave out: any category (condition ``or``) or all present ones (``and``)."""

    condition: str = "or"
    target: str = "secret"
    regexes: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    pattern: str
    secret_group: int | None = None
    keywords: tuple[str, ...] = ()
    min_entropy: float = 0.0
    confidence: str = "medium"
    path: str | None = None
    allowlist: tuple[Allow, ...] = field(default_factory=tuple)
    exclude_paths: tuple[str, ...] = ()

    @property
    def rank(self) -> int:
        return CONFIDENCE[self.confidence]


def _strict(kind, data: dict, what: str):
    """An instance of a dataclass from JSON; unknown fields are refused."""
    if not isinstance(data, dict):
        raise RuleError(f"{what} is not an object")
    names = {f.name for f in dataclasses.fields(kind)}
    if extra := sorted(set(data) - names):
        raise RuleError(f"{what} has unknown fields: {', '.join(extra)}")
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}
    if kind is Rule:
        for name in ("id", "name", "pattern"):
            if not isinstance(values.get(name), str):
                raise RuleError(f"{what} lacks {name}")
        values["allowlist"] = tuple(_strict(Allow, a, f"an allowlist of {what}") for a in values.get("allowlist", ()))
        if values.get("confidence", "medium") not in CONFIDENCE:
            raise RuleError(f"{what} has an unknown confidence")
    elif values.get("condition", "or") not in ("or", "and") or values.get("target", "secret") not in ("secret", "match", "line"):
        raise RuleError(f"{what} has an unknown condition or target")
    return kind(**values)


def parse(text: str) -> list[Rule]:
    """Rules of a JSON document ``{"rules": [...]}``."""
    data = json.loads(text)
    if not isinstance(data, dict) or set(data) != {"rules"}:
        raise RuleError("a rule file is an object with the one field rules")
    return [_strict(Rule, r, f"rule {r.get('id', '?') if isinstance(r, dict) else '?'}") for r in data["rules"]]


def load(path: str | Path) -> list[Rule]:
    """Rules of a JSON file, or of all .json files below a directory in the order of their names."""
    path = Path(path)
    files = [path] if path.is_file() else sorted(p for p in path.rglob("*.json") if p.is_file())
    return [r for f in files for r in parse(f.read_text(encoding="utf-8"))]


def authored() -> list[Rule]:
    """The built-in rules: three for literals assigned to credential keys, one for passwords in URIs."""
    # Patterns and allowlists of the four rules.
    key = r"""(?im)\b(?:[a-z][a-z0-9_]{0,48}[_-])?(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret)\b["']?[ \t]*[:=]"""
    values = {
        "double": r"""[ \t]*(?:\r?\n[ \t]*)?"([^"\r\n\\]{4,128})"[ \t]*(?:[,;})\]]|#|//|/\*|\r?$)""",
        "single": r"""[ \t]*(?:\r?\n[ \t]*)?'([^'\r\n\\]{4,128})'[ \t]*(?:[,;})\]]|#|//|/\*|\r?$)""",
        "unquoted": r"""[ \t]*([A-Za-z0-9][A-Za-z0-9!@#%^&*_.:/+=~-]{3,127})(?:[ \t]*(?:[,;#]|\r?$))""",
    }
    literals = r"(?i)^(?:true|false|null|none|undefined)$"
    templates = r"^\s*(?:\$|\{\{|<%|<|%[A-Z_]+%)"
    lookups = r"(?i)^(?:process\.env\.|(?:os\.)?environ\b|(?:getenv|env)\b|secrets\.|vars\.)"
    samples = r"(?i)^(?:your[_ -].*|replace[_ -].*|insert[_ -].*|example|sample|dummy|placeholder|redacted|<redacted>)$"
    config = r"(?i)^config\.[a-z_]\w*(?:\.[a-z_]\w*)*$"
    keywords = ("password", "passwd", "pwd", "secret", "api", "access", "auth", "client")
    out = [
        Rule(f"generic-credential-{k}", "Literal assigned to a credential key", key + v, 1, keywords, allowlist=(Allow(regexes=(literals, templates, lookups, samples) + (config,) * (k == "unquoted")),))
        for k, v in values.items()
    ]
    uri = r"""(?i)\b(?:postgres(?:ql)?|mysql|https?|rediss?)://[^:/@\s"'<>?#]*:([^/@\s"'<>?#]+)@(?:\[[0-9a-f:]+\]|[a-z0-9][a-z0-9.-]*)"""
    plain_templates = r"^(?:\$|\{\{|%[A-Z_]+%)"
    return [*out, Rule("uri-userinfo-password", "Password in URI authority userinfo", uri, 1, ("postgres", "mysql", "http", "redis"), allowlist=(Allow(regexes=(plain_templates, lookups, samples)),))]


def providers() -> list[Rule]:
    """Rules for published token formats of providers; opt-in, with high confidence and a keyword each."""
    # Id, name, pattern, keyword of each format.
    formats = [
        ("aws-access-key-id", "AWS access key id", r"\b((?:AKIA|ASIA)[A-Z2-7]{16})\b", "a"),
        ("github-pat", "GitHub personal access token", r"\b(ghp_[A-Za-z0-9]{36})\b", "ghp_"),
        ("gitlab-pat", "GitLab personal access token", r"\b(glpat-[A-Za-z0-9_-]{20})(?:[^A-Za-z0-9_-]|\z)", "glpat-"),
        ("slack-bot-token", "Slack bot token", r"\b(xoxb-[0-9]{10,13}-[0-9]{10,13}-[A-Za-z0-9]{24})\b", "xoxb-"),
        ("stripe-secret-key", "Stripe secret key", r"\b(sk_(?:live|test)_[A-Za-z0-9]{24,99})\b", "sk_"),
        ("sendgrid-api-key", "SendGrid API key", r"\b(SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})(?:[^A-Za-z0-9_-]|\z)", "sg."),
        ("npm-access-token", "npm access token", r"\b(npm_[A-Za-z0-9]{36})\b", "npm_"),
        ("digitalocean-pat", "DigitalOcean personal access token", r"\b(dop_v1_[a-f0-9]{64})\b", "dop_v1_"),
        ("huggingface-token", "Hugging Face token", r"\b(hf_[A-Za-z]{34})\b", "hf_"),
        ("google-api-key", "Google API key", r"\b(AIza[A-Za-z0-9_-]{35})(?:[^A-Za-z0-9_-]|\z)", "aiza"),
        ("twilio-api-key", "Twilio API key", r"\b(SK[0-9a-f]{32})\b", "sk"),
        ("doppler-api-token", "Doppler API token", r"\b(dp\.pt\.[A-Za-z0-9]{43})\b", "dp.pt."),
        ("linear-api-key", "Linear API key", r"\b(lin_api_[A-Za-z0-9]{40})\b", "lin_api_"),
        ("postman-api-token", "Postman API token", r"\b(PMAK-[0-9a-f]{24}-[0-9a-f]{34})\b", "pmak-"),
        ("pulumi-api-token", "Pulumi API token", r"\b(pul-[0-9a-f]{40})\b", "pul-"),
        ("shopify-access-token", "Shopify access token", r"\b(shpat_[0-9a-f]{32})\b", "shpat_"),
        ("databricks-api-token", "Databricks API token", r"\b(dapi[0-9a-f]{32})\b", "dapi"),
        ("anthropic-api-key", "Anthropic API key", r"\b(sk-ant-api03-[A-Za-z0-9_-]{93}AA)(?:[^A-Za-z0-9_-]|\z)", "sk-ant-api03-"),
        ("planetscale-api-token", "PlanetScale API token", r"\b(pscale_tkn_[A-Za-z0-9_-]{48})(?:[^A-Za-z0-9_-]|\z)", "pscale_tkn_"),
        ("airtable-pat", "Airtable personal access token", r"\b(pat[A-Za-z0-9]{14}\.[0-9a-f]{64})\b", "pat"),
        ("flyio-access-token", "Fly.io access token", r"\b(fo1_[A-Za-z0-9_-]{43})(?:[^A-Za-z0-9_-]|\z)", "fo1_"),
    ]
    return [Rule(i, n, p, 1, (k,), confidence="high") for i, n, p, k in formats]


def override(*sources: list[Rule]) -> list[Rule]:
    """Rules of all sources in the order of their ids; of rules with one id the last one counts."""
    return [r for _, r in sorted({r.id: r for source in sources for r in source}.items())]


def select(rules: list[Rule], min_confidence: str = "low") -> list[Rule]:
    """The rules of a confidence or more; none left is an error."""
    kept = [r for r in rules if r.rank >= CONFIDENCE[min_confidence]]
    if not kept:
        raise RuleError("no rules selected at the requested confidence")
    return kept


def check_entropy(value: float | None) -> None:
    if value is not None and not (math.isfinite(value) and 0 <= value <= 8):
        raise RuleError("the global entropy threshold must lie between 0 and 8")


def check(rules: list[Rule]) -> None:
    """Raise RuleError for the first rule that cannot work. Patterns are compiled as they will run, by Java."""
    import re

    from sieveline.functions.regex import Unsupported, groups, to_python, translate

    java = SparkSession.getActiveSession()._jvm.java.util.regex.Pattern

    def compiled(pattern: str, what: str, rule: Rule, bytes_: bool = True):
        try:
            return java.compile(translate(pattern) if bytes_ else pattern)
        except (Unsupported, Exception):
            raise RuleError(f"invalid regex syntax in {what} of rule {rule.id}") from None

    def checked(rule: Rule) -> bool:
        """Whether the pattern matches nothing at all; it must compile for one of the two engines."""
        try:
            translate(rule.pattern)
        except Unsupported:
            try:
                return bool(re.search(to_python(rule.pattern), b""))
            except (Unsupported, re.error):
                raise RuleError(f"invalid regex syntax in the pattern of rule {rule.id}") from None
        return compiled(rule.pattern, "the pattern", rule).matcher("").find()

    for r in rules:
        if not r.id:
            raise RuleError("a rule's id must not be empty")
        if not (math.isfinite(r.min_entropy) and 0 <= r.min_entropy <= 8):
            raise RuleError(f"invalid entropy threshold for rule {r.id}")
        matches_empty = checked(r)
        if r.secret_group is not None and not 0 <= r.secret_group <= len(groups(r.pattern)):
            raise RuleError(f"capture group missing for rule {r.id}")
        if matches_empty:
            raise RuleError(f"rule {r.id} matches empty input")
        if not all(r.keywords):
            raise RuleError(f"empty keyword for rule {r.id}")
        for p in (r.path, *r.exclude_paths):
            if p is not None:
                compiled(p, "a path predicate", r, bytes_=False)
        for a in r.allowlist:
            if not (a.regexes or a.paths or a.stopwords):
                raise RuleError(f"empty allowlist group for rule {r.id}")
            if not all(a.stopwords):
                raise RuleError(f"empty stopword for rule {r.id}")
            for x in a.regexes:
                compiled(x, "an allowlist", r)
            for x in a.paths:
                compiled(x, "an allowlist path", r, bytes_=False)


def as_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a table."""
    rows = [(r.id, r.name, r.pattern, r.secret_group, list(r.keywords), float(r.min_entropy), r.confidence, r.path, [(a.condition, a.target, list(a.regexes), list(a.paths), list(a.stopwords)) for a in r.allowlist], list(r.exclude_paths)) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def inventory(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """id, name and confidence, without patterns."""
    return as_frame(spark, rules).select("id", "name", "confidence").orderBy("id")
