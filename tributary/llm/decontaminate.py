"""Benchmark decontamination by template windows.

A text becomes a template: words are lower-cased and stripped of punctuation,
numbers, names (capitalised inside a sentence) and units (after a number)
become typed placeholders whose values are kept as slots.  Every run of
``WINDOW`` template words of a benchmark item is hashed; documents' windows are
joined on the hash.  A capitalised word that opens a sentence may be a name or
not: texts and items are read both ways, each reading of the one meets each of the
other, and each such pair is judged by itself.  Matches of one document
and item on one diagonal (document place minus item place) line up the item's
slots with the document's.  An item has leaked where enough of its words are
matched and its slots are consistent: equal values of the item stay equal in the
document, so a question asked with other numbers or names is found, and a
passage that only shares the placeholders is not.

Template windows need ``LITERALS`` words that are no placeholders.  Beside them,
plain windows hold the folded words themselves (case and punctuation removed,
no placeholders, no least number of literals), so that a copy is found whatever
its literals, case and punctuation.  A document's better kind of match is
reported, templates first where they tie.  Capitals are names only outside
passages in capitals.  An item that is shorter than a window is one window,
however short.  The benchmark's windows are sent to all tasks only while they
take at most ``SHARED`` bytes (measured); beyond that, windows of all documents
meet them in a shuffle.

Defined results: null and empty texts and items match nothing; texts of any
length are searched whole; rows that repeat an id and text, in either table,
give the matches of their id once; rows that share an id with other texts, or
have no id, are matched each by itself and reported under that id (or null) once
an item, by their best match; an empty table gives no rows; ``matches`` ignores
other columns, and ``keep_clean`` returns them as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import saved, tidy

#: Template words of a window; matched words that make a leak (all of a shorter item); literal words of a window; bytes of shared windows; share of slots that must agree.
WINDOW, MATCHED, LITERALS, SHARED, AGREE = 8, 13, 4, 64 << 20, 0.8
#: Units of measure and money that follow a number (fixed values).
UNITS = ("mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yards", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "oz", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "mph", "kmh", "usd", "eur", "gbp", "dollar", "dollars", "euro", "euros", "pound", "pounds", "cent", "cents", "percent", "degrees")
NUMBER, NAME, UNIT = K.U64(0xA5A5A5A5A5A5A501), K.U64(0xA5A5A5A5A5A5A502), K.U64(0xA5A5A5A5A5A5A503)
#: Keeps hashes of plain windows apart from those of templates.
PLAIN = K.U64(0x5C3A91E7D20B64F8)

_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True
_VALUES = K.byte_values(True, _SOLID)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
#: Punctuation beyond ASCII.
_MARKS = re.compile("[\u00a1\u00ab\u00b7\u00bb\u00bf\u2010-\u2027\u2030-\u205e\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a\uff1b\uff1f]")
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 63]] = True  # ! . : ?


def _hash_words(words) -> np.ndarray:
    raw, off = K.string_parts(pa.array([" ".join(words)]))
    w = K.split_words(raw, off, 0, 1)
    return np.sort(K.span_hashes(K.byte_sums(w.raw, _VALUES), w.start, w.end))


_UNIT_HASHES = _hash_words(UNITS)


def shouted(w: K.Words, capital: np.ndarray) -> np.ndarray:
    """Whether each word is in a passage in capitals.

    That is a run of words without a lower-case letter, most of them capitals,
    which has ``WINDOW`` words or is a whole text.
    """
    after = np.concatenate((w.raw[1:], np.zeros(1, np.uint8)))
    small = _LOWER[w.raw] | ((w.raw == 0xC3) & (after >= 0x9F) & (after <= 0xBF))
    lower = np.concatenate(([0], np.cumsum(small)))
    quiet = lower[w.end] > lower[w.start]
    cut = np.ones(len(w.start), bool)
    cut[1:] = (w.doc[1:] != w.doc[:-1]) | (quiet[1:] != quiet[:-1])
    first = np.flatnonzero(cut)
    length = np.diff(np.append(first, len(cut)))
    loud = ~quiet[first] & (2 * np.add.reduceat(capital.astype(np.int64), first) > length)
    loud &= (length >= WINDOW) | (length == w.counts[w.doc[first]])
    return np.repeat(loud, length)


def template(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template symbol, value, whether it is a placeholder, whether it may be a name that opens a sentence) of each word.

    Words without a letter or digit are placeholders of no kind (symbol 0).
    """
    if not len(w.start):
        return np.zeros(0, K.U64), np.zeros(0, K.U64), np.zeros(0, bool), np.zeros(0, bool)
    solid = _SOLID[w.raw]
    place = np.where(solid, np.arange(len(w.raw)), len(w.raw))
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    origin = np.minimum(nearest[w.start], w.end - 1)
    live = solid[origin]
    total = K.byte_sums(w.raw, _VALUES)
    value = np.where(live, K.span_hashes(total, origin, w.end), K.U64(0))
    lead = w.raw[origin]
    accent = np.zeros(len(w.start), bool)
    two = origin + 1 < w.end
    after = w.raw[np.minimum(origin + 1, len(w.raw) - 1)]
    accent[two] = (lead[two] == 0xC3) & (after[two] >= 0x80) & (after[two] <= 0x9E)
    number = live & _DIGIT[lead]
    opens = np.ones(len(w.start), bool)  # at the start of a text or sentence
    opens[1:] = (w.doc[1:] != w.doc[:-1]) | _STOP[w.raw[w.end[:-1] - 1]]
    lines = np.concatenate(([0], np.cumsum(w.raw == 10)))
    opens[1:] |= lines[w.start[1:]] != lines[w.start[:-1]]
    capital = live & (_UPPER[lead] | accent)
    capital &= ~shouted(w, capital)
    name = capital & ~opens
    unit = np.zeros(len(w.start), bool)
    unit[1:] = number[:-1] & (w.doc[1:] == w.doc[:-1])
    unit &= np.isin(value, _UNIT_HASHES)
    symbol = value.copy()
    symbol[number], symbol[name], symbol[unit] = NUMBER, NAME, UNIT
    return symbol, value, number | name | unit | ~live, capital & opens & ~unit


def plain_words(texts: pa.Array) -> K.Words:
    """Words of the texts with case folded and punctuation taken out."""
    folded = [x.lower() if x.isascii() else _MARKS.sub("", x.casefold()) for x in (x or "" for x in texts.to_pylist())]
    raw, off = K.string_parts(pa.array(folded, pa.large_string()))
    keep = _SOLID[raw] | K.SPACE[raw]
    return K.split_words(raw[keep], np.concatenate(([0], np.cumsum(keep)))[off], 0, len(folded))


def plain_windows(w: K.Words, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of ``size`` plain words."""
    at = K.windows_inside(w, size)
    return at, K.mix64(K.gram_hashes(value, size)[at] ^ PLAIN)


def readings(w: K.Words, made: tuple, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, hash, placeholder flags of all words, values) of windows of ``size`` words of a template, for each reading.

    The second reading takes capitals that open a sentence for names; without
    one it is the first.  Windows without enough literals are left out.
    """
    symbol, value, slot, opening = made
    at, out = K.windows_inside(w, size), []
    for second in (False, True):
        flags = slot | opening if second else slot
        literals = np.concatenate(([0], np.cumsum(~flags)))
        ok = literals[at + size] - literals[at] >= LITERALS
        h = K.gram_hashes(np.where(opening, NAME, symbol) if second else symbol, size)
        out.append((at[ok], h[at[ok]], flags, value))
    return out


def _digest() -> F.Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item, item_id, reading, words, place, size, hash, slots, values): the benchmark's windows, plain ones as reading 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = K.string_parts(b.column(2))
            names, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = []
            for k in range(b.num_rows):
                w = K.split_words(raw, off, k, k + 1)
                n = len(w.start)
                size = min(width, n)
                for reading, (at, h, slot, value) in enumerate(readings(w, template(w), size) if n else (), 1):
                    for p, x in zip(at, h, strict=True):
                        where = np.flatnonzero(slot[p : p + size])
                        out.append((names[k], ids[k], reading, n, int(p), size, int(x.view(np.int64)), where.tolist(), value[p + where].view(np.int64).tolist()))
                own = plain_words(b.column(2).slice(k, 1))
                n = len(own.start)
                if n:
                    at, h = plain_windows(own, K.word_hashes(own), min(width, n))
                    out += [(names[k], ids[k], 0, n, int(p), min(width, n), int(x.view(np.int64)), [], []) for p, x in zip(at, h, strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["item", "item_id", "reading", "words", "place", "size", "hash", "slots", "values"])

    source = items.where("text is not null").select(F.xxhash64(F.col("item_id").cast("long"), F.col("item_id").isNull(), _digest()).alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return source.dropDuplicates(["item"]).mapInArrow(tidy(run), "item long, item_id long, reading int, words int, place int, size int, hash long, slots array<int>, values array<long>")


def document_windows(docs: DataFrame, sizes: list[tuple[bool, int]], shared) -> DataFrame:
    """(doc_id, digest, own, at, size, hash, found) of the windows in ``shared`` (all windows where it is None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared is None else shared.value
        slots = None if wanted is None else (np.bincount((wanted >> K.U64(44)).astype(np.int64), minlength=1 << 20) > 0)

        def known(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if wanted is not None:
                near = np.flatnonzero(slots[(h >> K.U64(44)).astype(np.int64)])
                near = near[wanted[np.minimum(np.searchsorted(wanted, h[near]), len(wanted) - 1)] == h[near]] if len(wanted) else near[:0]
                at, h = at[near], h[near]
            return at, h

        for b in batches:
            raw, off = K.string_parts(b.column(2))
            for lo, hi in K.chunks(off):
                own = b.slice(lo, hi - lo)

                def rows(doc, reading: int, place, size: int, h, values) -> pa.RecordBatch:
                    doc = pa.array(doc)
                    return pa.RecordBatch.from_arrays([own.column(0).take(doc), own.column(1).take(doc), pa.array(np.full(len(doc), reading, np.int32)), pa.array(place, pa.int32()), pa.array(np.full(len(doc), size, np.int32)), pa.array(h.view(np.int64)), values], ["doc_id", "digest", "own", "at", "size", "hash", "found"])  # noqa: B023

                w, folded = K.split_words(raw, off, lo, hi), plain_words(own.column(2))
                hashes, made = K.word_hashes(folded), template(w)
                for plain, size in sizes:
                    if plain:
                        at, h = known(*plain_windows(folded, hashes, size))
                        if len(at):
                            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(at) + 1), pa.int32()), pa.array([], pa.int64()))
                            yield rows(folded.doc[at], 0, at - folded.first[folded.doc[at]], size, h, none)
                        continue
                    for reading, (at, h, slot, value) in enumerate(readings(w, made, size), 1):
                        at, h = known(at, h)
                        if len(at):
                            grid = at[:, None] + np.arange(size)
                            flags = slot[grid]
                            values = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(flags.sum(1)))), pa.int32()), pa.array(value[grid][flags].view(np.int64)))
                            yield rows(w.doc[at], reading, at - w.first[w.doc[at]], size, h, values)

    source = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "doc_id long, digest long, own int, at int, size int, hash long, found array<long>")


def matches(docs: DataFrame, items: DataFrame, width: int = WINDOW, matched: int = MATCHED) -> DataFrame:
    """One row per document and item that leaked: doc_id, item_id, matched_words, item_words, slots, consistent, exact."""
    best = leaks(docs, items, width, matched).groupBy("doc_id", "item_id").agg(F.max("m").alias("m"))
    return best.select("doc_id", "item_id", *(f"m.{c}" for c in ("matched_words", "item_words", "slots", "consistent", "exact")))


def leaks(docs: DataFrame, items: DataFrame, width: int = WINDOW, matched: int = MATCHED) -> DataFrame:
    """doc_id, digest (of the text), item_id, m: the match of each text with each item that leaked into it.

    Aggregation is per (document, item, diagonal) and word, so a window that
    many documents share spreads over as many groups.
    """
    spark = docs.sparkSession
    bench = saved(item_windows(items, width), "decon-items", True)
    measured = bench.agg(F.sum(64 + 12 * F.size("slots"))).first()[0] or 0
    plain = F.col("reading") == 0
    sizes = sorted((r["plain"], r["size"]) for r in bench.select(plain.alias("plain"), "size").distinct().collect())
    if measured <= SHARED:
        hashes = np.unique(bench.select("hash").toArrow()["hash"].to_numpy().view(K.U64))
        seen = document_windows(docs, sizes, spark.sparkContext.broadcast(hashes))
        met = seen.join(F.broadcast(bench), ["hash", "size"])  # its size was checked
    else:
        met = document_windows(docs, sizes, None).join(bench, ["hash", "size"])
    met = met.where(plain == (F.col("own") == 0)).withColumn("kind", 3 * F.col("reading") + F.col("own"))
    line = [F.col("doc_id"), F.col("digest"), F.col("item"), F.col("item_id"), F.col("kind"), (F.col("at") - F.col("place")).alias("diagonal")]
    met = met.where(F.size("found") == F.size("slots")).select(*line, "words", "place", "size", "slots", "values", "found")
    # per diagonal: which words of the item are matched, and which of its slots with what
    slot = F.transform(F.sequence(F.lit(0), F.size("slots") - 1), lambda k: F.struct((F.col("place") + F.element_at("slots", k + 1)).alias("p"), F.element_at("values", k + 1).alias("v"), F.element_at("found", k + 1).alias("d")))
    met = met.withColumn("pairs", F.when(F.size("slots") > 0, slot).otherwise(F.array().cast("array<struct<p:int,v:bigint,d:bigint>>")))
    text = ["doc_id", "digest", "item"]
    lines = met.groupBy(*text, "kind", "diagonal").agg(
        F.max("item_id").alias("item_id"),
        F.max("words").alias("words"),
        F.array_distinct(F.flatten(F.collect_set(F.sequence("place", F.col("place") + F.col("size") - 1)))).alias("covered"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    # an item value must not become two different values; the most usual one counts
    agree = F.aggregate(
        F.array_distinct(F.transform("pairs", lambda x: x["v"])),
        F.lit(0),
        lambda n, v: n + F.array_max(F.transform(F.filter("pairs", lambda x: x["v"] == v), lambda y: F.size(F.filter("pairs", lambda z: (z["v"] == v) & (z["d"] == y["d"]))))),
    )
    scored = lines.select(*text, "item_id", "kind", "words", F.size("covered").alias("hit"), F.size("pairs").alias("slots"), agree.alias("agree"), F.size(F.filter("pairs", lambda x: x["v"] == x["d"])).alias("same"))
    scored = scored.where((F.col("slots") == 0) | (F.col("agree") >= AGREE * F.col("slots")))
    out = scored.groupBy(*text, "kind").agg(F.max("item_id").alias("item_id"), F.sum("hit").alias("hit"), F.max("words").alias("item_words"), F.sum("slots").alias("slots"), F.sum("agree").alias("consistent"), F.sum("same").alias("same"))
    out = out.withColumn("matched_words", F.least("hit", "item_words")).where(F.col("matched_words") >= F.least(F.lit(matched), F.col("item_words")))
    return out.select("doc_id", "digest", "item_id", F.struct(F.col("matched_words").cast("int").alias("matched_words"), (F.col("kind") > 0).alias("template"), "item_words", F.col("slots").cast("int").alias("slots"), F.col("consistent").cast("int").alias("consistent"), (F.col("same") == F.col("slots")).alias("exact")).alias("m"))


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, into whose text no item leaked."""
    leaked = saved(leaks(docs, items, width).select("doc_id", "digest").distinct(), "decon-leaked", True)
    rows = docs.select(F.struct(*docs.columns).alias("row"), _digest().alias("mine"))
    return rows.join(leaked, F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.col("mine") == F.col("digest")), "left_anti").select("row.*")
