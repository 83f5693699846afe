"""Language identification by hierarchical discrimination.

A text's language family is predicted first, then one-versus-one linear support vector machines separate the languages within it.
Features are hashed counts of the byte n-grams (1 to 3, A-Z as a-z) of the whole text, square-rooted and scaled to
length one. All machines are fitted here, on a sample of labelled documents that is bounded for every language by
``per_language``; nothing but the text is an input of a prediction.

A null text and one without a letter are ``und`` with score 0, as is every text if nothing was learned. Rows with null labels or ids
are not learned from. Every label is learned; of very many, ``MOST_ROWS`` bounds the documents of each. Each row gets a row, and an empty table none;
extra columns are ignored. A very long text is read whole, alone in its step.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .seq import LOWER, slices

BINS, PER_LANGUAGE = 2048, 1000
#: Documents that are learned from, in all; each language has at least one.
MOST_ROWS = 50_000
#: Shares of a language that are ranked apart, so that a frequent one is not one task's.
SHARES = 64
#: Languages without a listed family that are families of their own; more are dealt out over families of at least so many.
ALONE = 12
#: The family of each language code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "finnic": ["fi", "et"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa"],
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def families(langs: list[str]) -> dict[str, str]:
    """The family of each language. Machines grow with the square of families and of a family's languages, so very many unlisted ones share some."""
    alone = sorted(x for x in langs if x not in _FAMILY)
    size = max(ALONE, math.isqrt(len(alone)))
    own = {x: f"only {x}" if len(alone) <= ALONE else f"other {i // size}" for i, x in enumerate(alone)}
    return own | {x: _FAMILY[x] for x in langs if x in _FAMILY}


def features(data: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of float32 features for each text of a run of bytes."""
    docs, lengths = len(offsets) - 1, np.diff(offsets)
    low = LOWER[data].astype(np.uint32)
    base = np.repeat(np.arange(docs, dtype=np.int64) * bins, lengths)
    room = np.repeat(offsets[1:], lengths) - np.arange(len(data))  # bytes up to the text's end
    total, gram = np.zeros(docs * bins, np.int64), np.zeros(len(data), np.uint32)
    shift = np.uint32(32 - (bins - 1).bit_length())
    for n in (1, 2, 3):
        gram[: len(data) - n + 1] |= low[n - 1 :] << np.uint32(8 * (n - 1))
        hashed = (((gram + np.uint32(n << 24)) * np.uint32(2654435761)) >> shift) % np.uint32(bins)
        whole = room >= n
        total += np.bincount((base + hashed)[whole], minlength=docs * bins)
    out = np.sqrt(total.reshape(docs, bins).astype(np.float32))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-12)


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """A linear support vector machine (squared hinge loss, both classes weighing the same) by accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    rate = 1 / (2 * 2 + penalty)  # rows have length one, and one more for the offset
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        pull = weight * y * gap
        step = np.append(x.T @ pull, pull.sum()) * 2 - penalty * v
        new = v + rate * step
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


class Model:
    """Machines among families and, in each family, among its languages: {(one, other): weights}."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.languages: dict[str, list[str]] = {}
        family = families(sorted(set(langs.tolist())))
        for lang in sorted(family):
            self.languages.setdefault(family[lang], []).append(lang)
        kinds = np.array([family[lang] for lang in langs], dtype=object)
        self.upper = self._machines(x, kinds, sorted(self.languages))
        self.lower = {f: self._machines(x, langs, own) for f, own in self.languages.items()}

    @staticmethod
    def _machines(x, labels, names):
        out = {}
        for a, b in itertools.combinations(names, 2):
            who = (labels == a) | (labels == b)
            out[a, b] = fit_machine(x[who].astype(np.float64), np.where(labels[who] == a, 1.0, -1.0)).astype(np.float32)
        return out

    @staticmethod
    def _vote(x, names, machines):
        """The name with most votes (ties: larger summed margin) and the logistic of its least margin."""
        votes, margins = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        least = np.full((len(x), len(names)), 6.0)
        for (a, b), w in machines.items():
            m = x @ w[:-1] + w[-1]
            for k, s in ((names.index(a), m), (names.index(b), -m)):
                votes[:, k] += s > 0
                margins[:, k] += s
                least[:, k] = np.minimum(least[:, k], s)
        best = np.argmax(votes + 0.5 / (1 + np.exp(-np.clip(margins, -30, 30))), axis=1)
        return best, 1 / (1 + np.exp(-4 * least[np.arange(len(x)), best]))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds = sorted(self.languages)
        which, sure = self._vote(x, kinds, self.upper)
        lang = np.empty(len(x), dtype=object)
        for k, f in enumerate(kinds):
            who = np.flatnonzero(which == k)
            best, more = self._vote(x[who], self.languages[f], self.lower[f])
            lang[who] = np.array(self.languages[f], dtype=object)[best]
            sure[who] = sure[who] * more
        return lang, sure


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def _first(rows: DataFrame, order: list[str], salt: Column, most: int) -> DataFrame:
    """The first ``most`` rows of each language in an order: first those of shares of a language, dealt out by ``salt``, then those of all shares."""
    for by in (["lang", "share"], ["lang"]):
        own = rows.withColumn("share", F.pmod(salt, F.lit(SHARES))) if "share" in by else rows
        rows = own.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= most)
    return rows


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text) of the first ``per_language`` rows of each language with a letter, in the order of a hash of the id, of rows with one id by their texts.

    One pass over the ids finds the ids, with a bounded number of rows of each language leaving a task or a share of it; their texts are read by these
    ids, and rows of one id count one by one.
    """
    open_ = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & _has_letter())
    ids = _first(open_.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")), ["h", "doc_id"], F.col("h"), per_language)
    # At most languages * per_language ids, which ``fit`` bounds by MOST_ROWS or the number of languages.
    rows = open_.select("lang", "doc_id", "text").join(F.broadcast(ids.select("lang", "doc_id").distinct()), ["lang", "doc_id"], "left_semi")
    return _first(rows.withColumn("h", F.xxhash64("doc_id")), ["h", "doc_id", "text"], F.xxhash64("text"), per_language).select("lang", "text")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, bins: int = BINS) -> Model | None:
    """Fit on at most ``per_language`` documents of each language and about MOST_ROWS in all; see ``sample``."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).agg(F.count_distinct("lang")).first()[0]
    if not known:
        return None
    chosen = sample(docs, max(1, min(per_language, MOST_ROWS // known)))

    def run(batches):
        for b in batches:
            for first, end, data, offsets in slices(b.column(1)):
                x = features(data, offsets, bins)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())], names=["lang", "x"])

    rows = chosen.mapInArrow(run, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return Model(np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<f4").reshape(len(rows), bins), np.array([r["lang"] for r in rows], dtype=object))


def identify(docs: DataFrame, model: Model | None = None, bins: int = BINS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = model or fit(docs, bins=bins)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("letter", T.BooleanType()), T.StructField("lang", T.StringType()), T.StructField("sure", T.DoubleType())])

    def run(batches):
        for b in batches:
            for first, end, data, offsets in slices(b.column(3)):
                if held.value is None:
                    lang, sure = [None] * (end - first), np.zeros(end - first)
                else:
                    lang, sure = held.value.predict(features(data, offsets, bins))
                kept = [c.slice(first, end - first) for c in b.columns[:3]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(np.asarray(sure, np.float64))], names=schema.names)

    rows = docs.select("doc_id", held_out().alias("held_out"), _has_letter().alias("letter"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    known = F.col("letter") & F.col("lang").isNotNull()
    return rows.select("doc_id", "held_out", F.when(known, F.col("lang")).otherwise("und").alias("lang_pred"), F.when(known, F.col("sure")).otherwise(0.0).alias("score"))
