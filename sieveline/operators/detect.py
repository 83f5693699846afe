"""The detection kernel: rules as data, applied to content views by one expression whose size does not depend on their number.

Rules become an array of structs in the plan. For every view a gate gives the numbers of the rules whose keywords it holds: a few
``contains`` for small rule sets, one Aho-Corasick automaton over all keywords for larger ones. Only those rules' patterns run. Matches, their byte
spans and all filters are array expressions of the same row; equal spans of several rules are merged there too, so a scan has no
shuffle. Rules whose captures Spark cannot place run as Python byte patterns, all of them in one Arrow step, on the views that pass the gate.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import keywords, literals, regex
from sieveline.functions import text as fn
from sieveline.plans.rules import Rule, authored

#: field_at: where the match begins, if it may be a public field of a Rust source.
CANDIDATE = "array<struct<start: bigint, end: bigint, generic: int, rank: int, rule_id: string, secret: string, field_at: bigint>>"
#: Rules whose matches may run into the next property name.
CONTEXTUAL = ("generic-api-key", "linkedin-client-id")
#: The rule whose match may be a field and its type; a rule of the same name from elsewhere is not meant.
TYPED = next(r for r in authored() if r.id == "generic-credential-unquoted")
#: Keywords up to which a gate of single ``contains`` is used; beyond, the automaton.
FEW = 24


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def keyword_gate(low: Column, rule: Rule) -> Column:
    """Whether a lower-cased view holds one of the rule's keywords; a rule without any is always considered."""
    return any_of([F.contains(low, F.lit(k.lower())) for k in rule.keywords]) if rule.keywords else F.lit(True)


MATCH = "array<struct<mstart: bigint, match: string, lead: string, secret: string>>"


def python_matches(rules: list[Rule], which: list[int]):
    """A function of Arrow batches (views, rule numbers per view): matches of the rules ``which``, with their numbers, per view."""
    wanted = {i: (regex.to_python(rules[i].pattern), rules[i].secret_group) for i in which}

    def secret_of(m, group: int | None) -> tuple[int, int] | None:
        if group is not None:
            return m.span(group) if m.start(group) >= 0 else None
        return next((m.span(g) for g in range(1, m.re.groups + 1) if m.start(g) >= 0 and m.span(g)[0] < m.span(g)[1]), m.span())

    def one(view: str | None, ids: list[int]) -> list[dict]:
        out, data = [], None
        for i in (i for i in ids if view is not None and i in wanted):
            data = view.encode("latin-1") if data is None else data
            text = lambda a, b: data[a:b].decode("latin-1")
            for m in re.compile(wanted[i][0]).finditer(data):
                if (span := secret_of(m, wanted[i][1])) is not None:
                    out.append({"rule": i, "mstart": m.start(), "match": text(*m.span()), "lead": text(m.start(), span[0]), "secret": text(*span)})
        return out

    fields = [("rule", pa.int32()), ("mstart", pa.int64()), ("match", pa.string()), ("lead", pa.string()), ("secret", pa.string())]

    def run(views: pa.Array, ids: pa.Array) -> pa.Array:
        found = [[one(v, i) for v, i in zip(vs.as_py(), nested.as_py(), strict=True)] for vs, nested in zip(views, ids, strict=True)]
        return pa.array(found, pa.list_(pa.list_(pa.struct(fields))))

    return F.arrow_udf(run, "array<array<struct<rule: int, mstart: bigint, match: string, lead: string, secret: string>>>")


#: Marks around a match and its parts; views hold no characters beyond Latin-1.
_OPEN, _LEAD, _SECRET, _CLOSE = "\ue000", "\ue001", "\ue002", "\ue003"
_CHUNK = 256


def _sums(sizes: Column) -> Column:
    """Sums of what stands before each element, and of all: one element more than ``sizes``. Short arrays only."""
    zero = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(sizes, zero, lambda acc, n: F.concat(acc, F.array((F.element_at(acc, -1) + n).cast("bigint"))))


def running(sizes: Column) -> Column:
    """Sums of what stands before each element. Arrays grow by copies, so long ones are summed in chunks and over the chunks."""

    def chunked(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(s), F.lit(1)) - 1) / _CHUNK).cast("int"))
        return F.transform(starts, lambda k: _sums(F.slice(s, k * _CHUNK + 1, F.lit(_CHUNK))))

    def shifted(own: Column) -> Column:
        totals = _sums(F.transform(own, lambda c: F.element_at(c, -1)))
        return fn.let(totals, lambda before: F.flatten(F.transform(own, lambda c, k: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: x + F.get(before, k)))))

    return fn.let(fn.let(sizes, chunked), shifted)


def marked(pattern: str, group: int | None) -> tuple[str, str, bool]:
    """(Java pattern, replacement that marks a match's parts, whether the whole match stands in for an empty secret); Unsupported if it has no fixed place.

    Group 0 is the whole match; null is the only capture, or the whole match where that is empty or there is none.
    """
    found = regex.groups(pattern)
    if group is None and len(found) > 1:
        raise regex.Unsupported("a rule with several captures must name its secret's group")
    whole_too = group is None and bool(found)
    group = (1 if found else 0) if group is None else group
    lead, number = "", 0
    if group:
        pattern, number = regex.with_lead(pattern, group)
        lead = "$1"
    return regex.translate(pattern), f"{_OPEN}$0{_LEAD}{lead}{_SECRET}${number}{_CLOSE}", whole_too


def placed(view: Column, pattern: Column, marks: Column, whole: Column) -> Column:
    """All matches: array of MATCH, offsets and lengths in bytes. The pattern runs once over the view.

    ``lead`` is what of the match stands before the secret.
    """
    parts = F.split(F.regexp_replace(view, pattern, marks), _OPEN, -1)
    between = lambda x, a, b: F.substring_index(F.substring_index(x, b, 1), a, -1)

    def build(p: Column) -> Column:
        pieces = F.slice(p, F.lit(2), F.size(p) - 1)
        first = F.length(F.get(p, F.lit(0)))
        text = lambda x: F.substring_index(x, _LEAD, 1)
        sizes = F.transform(pieces, lambda x: (F.length(text(x)) + F.length(F.substring_index(x, _CLOSE, -1))).cast("bigint"))

        def rows(at: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                own = between(x, _SECRET, _CLOSE)
                empty = whole & (own == "")
                lead = F.when(empty, "").otherwise(between(x, _LEAD, _SECRET))
                secret = F.when(empty, text(x)).otherwise(own)
                return F.struct((F.get(at, i) + first).alias("mstart"), text(x).alias("match"), lead.alias("lead"), secret.alias("secret"))

            return F.transform(pieces, one)

        return fn.let(running(sizes), rows)

    return fn.let(parts, build)


def native_matches(view: Column, pattern: str, group: int | None) -> Column:
    """Matches of one pattern; raises Unsupported for what Spark's functions cannot place."""
    return placed(view, *map(F.lit, marked(pattern, group)))


_ALLOW = "struct<both: boolean, target: string, regexes: array<string>, paths: array<string>, stopwords: array<string>>"
_RULE = (
    "array<struct<id: string, rank: int, generic: int, pattern: string, marks: string, whole: boolean, requires: string, threshold: double, contextual: boolean, "
    f"prose: boolean, typed: boolean, path: string, skip: array<string>, allow: array<{_ALLOW}>>>"
)


class Rules:
    """A rule set as data of the plan."""

    def __init__(self, rules: list[Rule], min_entropy: float | None = None):
        self.rules, self.python = rules, []
        rows = []
        for i, r in enumerate(rules):
            try:
                pattern, marks, whole = marked(r.pattern, r.secret_group)
            except regex.Unsupported:
                pattern, marks, whole = None, None, False
                self.python.append(i)
            needed = literals.required(r.pattern)
            alone = [p for a in r.allowlist if a.paths and (a.condition == "or" or not (a.regexes or a.stopwords)) for p in a.paths]
            allow = [
                {"both": a.condition == "and", "target": a.target, "regexes": [regex.translate(x) for x in a.regexes], "paths": list(a.paths), "stopwords": [w.lower() for w in a.stopwords]}
                for a in r.allowlist
            ]
            rows.append({
                "id": r.id, "rank": -r.rank, "generic": int(r.id.startswith("generic-")), "pattern": pattern, "marks": marks, "whole": whole,
                "requires": needed and regex.translate(needed), "threshold": r.min_entropy if min_entropy is None else min_entropy,
                "contextual": r.id in CONTEXTUAL, "prose": r.id.startswith("generic-credential-"), "typed": r == TYPED, "path": r.path, "skip": [*r.exclude_paths, *alone], "allow": allow,
            })
        self.typed = any(row["typed"] for row in rows)
        self.table = F.from_json(F.lit(json.dumps(rows)), _RULE)

    def gate(self, views: Column, on: bool = True) -> Column:
        """For each view of an array, the numbers of the rules whose keywords it holds (of all rules, if not ``on``)."""
        words = [k for r in self.rules for k in r.keywords]
        if not on:
            return F.transform(views, lambda _: F.array(*(F.lit(i) for i in range(len(self.rules)))))
        if len(words) > FEW or not all(k.isascii() for k in words):
            return keywords.finder([r.keywords for r in self.rules])(views)
        # One array of numbers, with nulls for the rules that do not meet.
        numbers = lambda low: F.array(*(F.when(keyword_gate(low, r), F.lit(i)) for i, r in enumerate(self.rules)))
        return F.transform(views, lambda v: F.filter(fn.let(F.lower(v), numbers), lambda i: i.isNotNull()))

    def found(self, views: Column, path: Column, gate: bool = True) -> tuple[Column, Column | None]:
        """(rule numbers per view, matches by Python per view or None): what ``candidates`` needs, as columns to be computed before it."""
        ids = self.gate(views, gate)
        return ids, python_matches(self.rules, self.python)(views, ids) if self.python else None

    def candidates(self, view: Column, ids: Column, by_python: Column | None, path: Column) -> Column:
        """Findings of a view for the rules ``ids``, as CANDIDATE."""

        def passes(rule: Column) -> Column:
            inside = F.coalesce(F.rlike(path, rule["path"]), F.lit(True))
            return inside & ~F.exists(rule["skip"], lambda p: F.rlike(path, p))

        def kept(m: Column, rule: Column) -> Column:
            secret, lead = m["secret"], m["lead"]
            tail = F.substring(m["match"], F.length(lead) + F.length(secret) + 1, F.length(m["match"]))
            ok = (secret != "") & ~fn.is_placeholder(secret)
            ok = ok & ~(rule["contextual"] & fn.is_non_value(lead, tail))
            ok = ok & ((rule["threshold"] <= 0) | (fn.entropy(secret) > rule["threshold"]))
            ok = ok & ~(rule["prose"] & fn.is_prose(lead, secret))
            return ok & ~F.exists(rule["allow"], lambda a: allowed(a, path, m, view))

        def shape(m: Column, rule: Column) -> Column:
            start = (m["mstart"] + F.length(m["lead"])).cast("bigint")
            end = (start + F.length(m["secret"])).cast("bigint")
            field = F.when(rule["typed"] & F.endswith(path, F.lit(".rs")) & m["lead"].rlike(r":[ \t\n\f\r]*\z"), m["mstart"].cast("bigint"))
            return F.struct(
                start.alias("start"), end.alias("end"), rule["generic"].alias("generic"), rule["rank"].alias("rank"), rule["id"].alias("rule_id"), m["secret"].alias("secret"), field.alias("field_at")
            )

        def native(i: Column) -> Column:
            def of(rule: Column) -> Column:
                run = passes(rule) & rule["pattern"].isNotNull() & F.coalesce(F.rlike(view, rule["requires"]), F.lit(True))
                matches = placed(view, rule["pattern"], rule["marks"], rule["whole"])
                return F.when(run, F.transform(F.filter(matches, lambda m: kept(m, rule)), lambda m: shape(m, rule))).otherwise(F.array().cast(CANDIDATE))

            return fn.let(F.get(self.table, i), of)

        out = F.flatten(F.transform(ids, native))
        if by_python is not None:
            rule = lambda m: F.get(self.table, m["rule"])
            mine = F.filter(by_python, lambda m: passes(rule(m)) & kept(m, rule(m)))
            out = F.concat(out, F.transform(mine, lambda m: shape(m, rule(m))))
        return out


def allowed(a: Column, path: Column, m: Column, view: Column) -> Column:
    """Whether an allowlist group leaves a match out: its categories are combined by its condition."""
    lines = fn.surrounding_lines(view, m["mstart"].cast("int"), (m["mstart"] + F.length(m["match"])).cast("int"))
    target = F.when(a["target"] == "secret", m["secret"]).when(a["target"] == "match", m["match"]).otherwise(lines)
    parts = [
        (F.size(a["regexes"]) > 0, F.exists(a["regexes"], lambda x: F.rlike(target, x))), (F.size(a["paths"]) > 0, F.exists(a["paths"], lambda x: F.rlike(path, x))),
        (F.size(a["stopwords"]) > 0, F.exists(a["stopwords"], lambda x: F.contains(F.lower(m["secret"]), x))),
    ]
    return F.when(a["both"], reduce(lambda x, y: x & y, (~has | meets for has, meets in parts))).otherwise(reduce(lambda x, y: x | y, (has & meets for has, meets in parts)))


def candidates(view: Column, low: Column, path: Column, rule: Rule, min_entropy: float | None = None, gate: bool = True) -> Column:
    """One rule's findings in a view, as CANDIDATE."""
    return all_candidates(view, low, path, [rule], min_entropy, gate)


def all_candidates(view: Column, low: Column, path: Column, rules: list[Rule], min_entropy: float | None = None, gate: bool = True) -> Column:
    """Findings of all rules in a single view, as CANDIDATE. ``low`` is not needed any more and may be anything."""
    own = Rules(rules, min_entropy)
    ids, by_python = own.found(F.array(view), path, gate)
    return own.candidates(view, F.get(ids, F.lit(0)), None if by_python is None else F.get(by_python, F.lit(0)), path)


def merge(found: Column, rules: int) -> Column:
    """One finding per span: the primary rule is the first not called generic, then the most confident, then the first by id.

    ``matched`` has the sorted ids of all rules with that span, and is null for a single one.
    """

    def primary(s: Column) -> Column:
        same = lambda x, y: F.coalesce((x["start"] == y["start"]) & (x["end"] == y["end"]), F.lit(False))

        def with_ids(x: Column, i: Column) -> Column:
            met = F.filter(F.slice(s, i + 1, F.lit(max(1, rules))), lambda y: same(x, y))
            ids = F.array_sort(F.array_distinct(F.transform(met, lambda y: y["rule_id"])))
            several = F.when(same(x, F.get(s, i + 1)), F.when(F.size(ids) > 1, ids))  # equal spans are neighbours
            return F.when(~same(x, F.get(s, i - 1)), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rule_id"].alias("rule_id"), several.alias("matched"), x["secret"].alias("secret")))

        return F.filter(F.transform(s, with_ids), lambda x: x.isNotNull())

    return fn.let(F.sort_array(found), primary)


def merge_by_window(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same merge over exploded candidates (keys, start, end, generic, rank, rule_id): the primary row of each span."""
    from pyspark.sql import Window

    span = [*keys, "start", "end"]
    order = Window.partitionBy(*span).orderBy("generic", "rank", "rule_id")
    ids = F.array_sort(F.collect_set("rule_id").over(Window.partitionBy(*span)))
    out = rows.withColumn("matched", F.when(F.size(ids) > 1, ids)).withColumn("nth", F.row_number().over(order))
    return out.where("nth = 1").drop("nth", "generic", "rank")
