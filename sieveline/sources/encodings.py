"""UTF-16 contents with a byte order mark: decoding, and mapping spans back to source bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import let


def utf16_order(content: Column) -> Column:
    """UTF-16LE or UTF-16BE by the byte order mark, else null; a UTF-32 mark is raw content."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(F.startswith(head, F.lit("FFFE")) & (head != "FFFE0000"), "UTF-16LE").when(F.startswith(head, F.lit("FEFF")), "UTF-16BE")


def well_formed(content: Column, order: Column) -> Column:
    """Whether the bytes after the mark are whole units without a lone surrogate, checked on the hex form of the units."""
    hexed = F.hex(F.substring(content, F.lit(3), F.octet_length(content)))

    def check(x: Column) -> Column:
        # One letter per unit: H and L for surrogates, . for others; pairs must match.
        at = F.when(x["order"] == "UTF-16LE", 3).otherwise(1)
        kinds = let(at, lambda a: F.transform(F.regexp_extract_all(x["hexed"], F.lit("(....)"), F.lit(1)), lambda u: F.when(F.substring(u, a, F.lit(2)).between("D8", "DB"), "H").when(F.substring(u, a, F.lit(2)).between("DC", "DF"), "L").otherwise(".")))
        return (F.length(x["hexed"]) % 4 == 0) & ~F.replace(F.array_join(kinds, ""), F.lit("HL"), F.lit("")).rlike("[HL]")

    return let(F.struct(hexed.alias("hexed"), order.alias("order")), check)


def decoded(inputs: DataFrame) -> DataFrame:
    """inputs with UTF-16 contents as UTF-8, a flag ``utf16``, and a message in ``error`` in place of the content of a malformed one."""
    marked = inputs.withColumn("_order", utf16_order(F.col("content")))
    bad = F.when(F.col("_order").isNotNull(), ~well_formed(F.col("content"), F.col("_order"))).otherwise(F.lit(False))
    marked = marked.withColumn("_bad", bad)
    body = F.substring(F.col("content"), F.lit(3), F.octet_length("content"))
    le, be = (F.when((F.col("_order") == o) & ~F.col("_bad"), F.encode(F.decode(body, o), "UTF-8")) for o in ("UTF-16LE", "UTF-16BE"))
    known = F.col("error") if "error" in inputs.columns else F.lit(None).cast("string")
    out = marked.withColumns({
        "utf16": F.col("_order").isNotNull(), "error": F.coalesce(known, F.when(F.col("_bad"), "invalid UTF-16 content")),
        "content": F.when(~F.col("_bad"), F.coalesce(le, be, F.col("content"))),
    })
    return out.drop("_order", "_bad")


def decode_utf16(inputs: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(inputs with UTF-16 contents as UTF-8 and a flag ``utf16``, error rows for malformed ones). ``strict``: a malformed one fails the job."""
    both = decoded(inputs)
    told = F.raise_error(F.concat(F.col("error"), F.lit(": "), F.coalesce("path", F.lit("")))).cast("boolean")
    good = both.where(F.when(F.col("error").isNull(), True).otherwise(told if strict else F.lit(False)))
    return good.drop("error"), both.where("error is not null").select("path", F.col("error").alias("message"))


PLACES = "array<struct<start: bigint, end: bigint, line: bigint, column: bigint>>"


def _places(views: pa.Array, starts: pa.Array, ends: pa.Array, decoded: pa.Array) -> pa.Array:
    out, none = [], np.zeros(0, np.int64)
    for view, start, end, utf16 in zip(views, starts, ends, decoded, strict=True):
        if not view.is_valid or not start.is_valid:
            out.append((none, none, none, none))
            continue
        data = np.frombuffer(view.as_py().encode("latin-1"), np.uint8)
        a, b = (np.asarray(x.values, np.int64) for x in (start, end))
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, a, "left")
        first = np.append(0, breaks + 1)[line]  # where each one's line starts
        if utf16.as_py():
            lead = (data & 0xC0) != 0x80
            units = np.append(0, np.cumsum(np.where(lead, 1 + (data >= 0xF0), 0)))
            behind = np.append(lead, True)
            # A start inside a character is that character's; units so far hold it already.
            own = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0)) if len(data) else none
            inside = ~behind[a]
            at = a.copy()
            at[inside] = own[a[inside]]
            column = 2 * (units[at] - units[first]) + 2 * (line == 0)
            a, b = 2 + 2 * units[at], 2 + 2 * units[b]
        else:
            column = a - first
        out.append((a, b, line + 1, column))
    flat = [pa.array(np.concatenate(c) if out else none) for c in zip(*out, strict=True)] or [pa.array(none)] * 4
    sizes = np.append(0, np.cumsum([len(x[0]) for x in out], dtype=np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(flat, ["start", "end", "line", "column"]))


def places(view: Column | str, starts: Column, ends: Column, decoded: Column | str) -> Column:
    """For spans of a view: array of (start, end, line, column) in the source. Lines count from 1, columns are bytes from 0.

    One sorted list of the line breaks of a view is searched for all its spans, so the work is linear in both. In decoded UTF-16 content places are
    those of the source: the mark and two bytes for each unit, a span inside a character widened to it; on the first line the mark counts.
    """
    return F.arrow_udf(_places, PLACES)(view, starts, ends, decoded)


def _place(view: Column, start: Column, end: Column) -> Column:
    one = lambda x: F.array(x.cast("bigint"))
    return F.get(places(view, one(start), one(end), F.lit(True)), F.lit(0))


def source_start(view: Column, start: Column) -> Column:
    """The source byte offset of a start in the Latin-1 view of decoded content."""
    return _place(view, start, start)["start"]


def source_end(view: Column, end: Column) -> Column:
    """The source byte offset of an end in the Latin-1 view of decoded content; an end inside a character is behind it."""
    return _place(view, end, end)["end"]


def source_column(view: Column, start: Column) -> Column:
    """0-based byte column of a start in the source."""
    return _place(view, start, start)["column"]


def source_offset(prefix: Column) -> Column:
    """The source byte offset after a decoded prefix: the mark, and two bytes for each UTF-16 unit."""
    units = F.length(prefix) + F.length(F.regexp_replace(prefix, r"[^\x{10000}-\x{10FFFF}]", ""))
    return (2 + 2 * units).cast("long")
