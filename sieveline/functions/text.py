"""Scalar functions of the scanner as column expressions. Contents are Latin-1 views: one character for every byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Contents that stand in for a secret.
PLACEHOLDERS = ("[redacted]", "changeme", "your_secret_here", "your_api_key_here", "replace_me", "example", "xxxxxxxx")
REDACTED = "[REDACTED]"
_BLANK = r"[ \t\n\f\r]"
FINGERPRINT_DOMAIN = "sieveline/finding/v1"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def latin1(content: Column) -> Column:
    """Bytes, or a text's UTF-8 bytes, with one character for each byte."""
    return F.decode(content, "ISO-8859-1")


def entropy(secret: Column) -> Column:
    """Shannon entropy in bits per byte."""
    chars = F.array_remove(F.split(secret, ""), "")

    def total(c: Column) -> Column:
        n = F.size(c).cast("double")
        share = lambda x: F.length(secret) - F.length(F.replace(secret, x, F.lit("")))
        return F.aggregate(F.array_sort(F.array_distinct(c)), F.lit(0.0), lambda s, x: s - (share(x) / n) * F.log2(share(x) / n))

    return let(chars, total)


def is_placeholder(secret: Column) -> Column:
    first = F.substring(secret, 1, 1)
    same = (F.length(secret) >= 8) & (F.replace(secret, first, F.lit("")) == "")
    return F.lower(secret).isin(*PLACEHOLDERS) | same


def is_prose(lead: Column, secret: Column) -> Column:
    """A token-like assignment whose value reads as prose: eight words or more, with clause punctuation."""
    key = F.regexp_replace(F.lower(F.regexp_extract(lead, r"^([^=:]*)[=:]", 1)), "[^a-z0-9]", "")
    words = F.size(F.array_remove(F.split(secret, _BLANK + "+"), ""))
    return lead.rlike("[=:]") & key.rlike(r"(?:apikey|accesstoken|authtoken)\z") & (words >= 8) & secret.rlike(r"[,;.!?](?:" + _BLANK + r"|\z)")


def is_non_value(lead: Column, tail: Column) -> Column:
    """A contextual match that ran into the next quoted property name, or past a comma into prose."""
    trimmed = F.regexp_replace(lead, _BLANK + r"+\z", "")
    last = F.substring(trimmed, -1, 1)
    quoted = last.isin("'", '"')
    next_name = quoted & (F.substring(tail, 1, 1) == last) & tail.rlike(r"(?s)\A." + _BLANK + "*:")
    before = F.substring(F.regexp_replace(F.substring_index(trimmed, ",", 1), _BLANK + r"+\z", ""), -1, 1)
    return next_name | (F.contains(trimmed, F.lit(",")) & (~quoted | ~before.isin("'", '"')))


def line_of(prefix: Column) -> Column:
    """1-based line of what follows a prefix."""
    return (F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit("")))).cast("long") + 1


def column_of(prefix: Column) -> Column:
    """0-based byte column of what follows a prefix."""
    return F.length(F.substring_index(prefix, "\n", -1)).cast("long")


def surrounding_lines(view: Column, start: Column, end: Column) -> Column:
    """The lines that a span of a view lies on, without the last line's end. start is 0-based, end exclusive."""
    before = F.substring_index(F.substring(view, F.lit(1), start), "\n", -1)
    last = F.greatest(end - 1, F.lit(0))
    return F.concat(before, F.substring(view, start + 1, last - start), F.substring_index(F.substring(view, last + 1, F.length(view)), "\n", 1))


def logical_identity(path: Column) -> Column:
    """A path without its ``.`` components."""
    kept = F.filter(F.split(path, "/"), lambda x, i: (x != ".") & ((x != "") | (i == 0)))
    return F.array_join(kept, "/")


def framed(*parts: Column) -> Column:
    """Parts with their byte lengths in front, so that different parts never run into the same string."""
    return F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p, F.lit(",")) for p in parts))


def fingerprint(rule_id: Column, identity: Column, secret: Column, key: str | None = None) -> Column:
    """SHA-256 over rule, identity and secret, each with its length; with a key, an HMAC-like keyed form."""
    body = framed(F.lit(FINGERPRINT_DOMAIN), rule_id, identity, secret)
    plain = F.sha2(body, 256)
    return plain if key is None else F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), body), 256)), 256)


def explanation(name: Column, confidence: Column, base64: Column, utf16: Column) -> Column:
    return F.concat(
        F.lit("Matched "), name, F.lit(" ("), confidence, F.lit(" confidence)"), F.when(base64, "; detected inside Base64 content").otherwise(""), F.lit("; not live-validated"),
        F.when(utf16, "; decoded UTF-16 BOM text").otherwise(""),
    )


def path_uri(path: Column) -> Column:
    """A path as an RFC 3986 URI reference; absolute paths get the file scheme."""
    raw = F.regexp_extract_all(F.hex(F.encode(path, "UTF-8")), F.lit("(..)"), F.lit(1))
    coded = F.transform(raw, lambda h: F.when(let(F.decode(F.unhex(h), "ISO-8859-1"), lambda c: c.rlike(r"^[A-Za-z0-9\-._~/]$")), F.decode(F.unhex(h), "ISO-8859-1")).otherwise(F.concat(F.lit("%"), h)))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "file://").otherwise(""), F.array_join(coded, ""))


def archive_format(name: Column, content: Column) -> Column:
    """zip, gzip, tar or null, by magic number first and then by extension; content is bytes."""
    head = F.hex(F.substring(content, 1, 4))
    low = F.lower(name)
    return (
        F.when(head.isin("504B0304", "504B0506") | low.rlike(r"\.zip\z"), "zip")
        .when(F.startswith(head, F.lit("1F8B")) | low.rlike(r"\.(gz|tgz)\z"), "gzip")
        .when((F.hex(F.substring(content, 258, 5)) == "7573746172") | low.rlike(r"\.tar\z"), "tar")
    )


def gzip_member(name: Column) -> Column:
    """The name of what a gzip file holds: .tgz is a .tar, .gz goes, else ``content``."""
    base = F.regexp_replace(name, r"^.*[!/\\]", "")
    low = F.lower(base)
    return F.when(low.rlike(r"\.tgz\z"), F.regexp_replace(base, r"(?i)\.tgz\z", ".tar")).when(low.rlike(r"\.gz\z"), F.regexp_replace(base, r"(?i)\.gz\z", "")).otherwise("content")
