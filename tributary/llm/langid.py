"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte n-grams (1 to 3 bytes, lower-cased,
everything but letters folded to one separator), normalised to length 1.  Each
language has a few centroids, found by spherical k-means; the nearest by cosine
names the language, and a text that is far from every centroid is rejected.

Document frequencies count every training document.  Centroids are fitted on a
sample of about ``SAMPLE`` training texts: an even share of different texts of
every language (``LEAST`` at least, all where there are fewer), so that no
language and no rare text is crowded out by copies.  That bound is the only one
here; every language present is learnt.  Whole texts are used throughout.

A text is rejected where its cosine is below ``FAR`` of what is usual for its
language and its number of n-grams: the usual cosine is measured on the sampled
texts, thinned to ever fewer n-grams, and read off in between.

Defined results: null texts and texts without a letter are ``und``, score 0,
rejected; very long texts are judged whole; without training rows everything is
``und``; ties go to the language first in code point order; repeated rows are
judged alike; an empty table gives no rows; other columns are ignored, and
``keep_identified`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import drop_saved, give_back, saved, tidy

DIM = 4096
#: Training texts that the centroids are fitted on, about; texts of a language at least; centroids per language.
SAMPLE, LEAST, CENTROIDS = 2000, 8, 4
UNKNOWN = "und"
_CHUNK_DOCS, _CHUNK_BYTES = 128, 1 << 18
#: Sharpness of the score; share of the usual cosine below which a text is rejected; numbers of n-grams at which that is measured.
SHARP, FAR = 25.0, 0.4
THIN = np.array([4, 16, 64, 256, 1024, 4096, 1 << 14])

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def chunk_counts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """n-gram counts (documents x DIM) of consecutive documents."""
    b = _FOLD[raw]
    if len(b) > 1:  # two-byte capitals of Latin-1: C3 80-9E except D7's place
        up = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        b[up] += 0x20
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    out = np.zeros(n * DIM, np.int64)
    code = np.zeros(len(b), np.uint32)
    for k in range(3):
        m = len(b) - k
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | b[k:]
        spaces = b[:m] == 32
        for j in range(1, k + 1):
            spaces = spaces & (b[j : m + j] == 32)
        ok = (doc[:m] == doc[k:]) & ~spaces
        h = ((code + np.uint32((k + 1) << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        out += np.bincount((doc[:m] * DIM + h)[ok], minlength=n * DIM)
    return out.reshape(n, DIM)


def counts(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first document, end, counts) over a column, whole texts, in bounded pieces."""
    raw, off = K.string_parts(col)
    for lo, hi in K.chunks(off, _CHUNK_BYTES):
        for a in range(lo, hi, _CHUNK_DOCS):
            z = min(a + _CHUNK_DOCS, hi)
            yield a, z, chunk_counts(raw[off[a] : off[z]], off[a : z + 1] - off[a])


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # language of each centroid
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    floor: np.ndarray = field(default_factory=lambda: np.zeros((0, len(THIN))))  # language x size
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIM, np.float32))

    def vectors(self, c: np.ndarray) -> np.ndarray:
        v = c.astype(np.float32)
        np.log1p(v, out=v)
        v *= self.idf
        v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)[:, None]
        return v

    def judge(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, cosine, rejected) of each row of counts."""
        n = len(c)
        if not self.languages:
            return np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.ones(n, bool)
        cos = self.vectors(c) @ self.centroids.T
        best = np.full((n, len(self.languages)), -1.0)
        for k, o in enumerate(self.owner):
            best[:, o] = np.maximum(best[:, o], cos[:, k])
        at = best.argmax(1)
        top = best[np.arange(n), at]
        score = 1 / np.exp(SHARP * (best - top[:, None])).sum(1)
        return at, score, top, top < self.least(at, c.sum(1))

    def least(self, lang: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Least cosine of a text with so many n-grams, between the measured sizes by their logarithm."""
        x = np.interp(np.log(np.maximum(grams, 1)), np.log(THIN), np.arange(len(THIN)))
        lo = np.minimum(x.astype(np.int64), len(THIN) - 2)
        return self.floor[lang, lo] * (lo + 1 - x) + self.floor[lang, lo + 1] * (x - lo)


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; deterministic: farthest-first seeds from the row nearest the mean."""
    mean = v.mean(0)
    seeds = [int((v @ mean).argmax())]
    near = v @ v[seeds[0]]
    while len(seeds) < min(k, len(v)):
        far = int(near.argmin())
        seeds.append(far)
        near = np.maximum(near, v @ v[far])
    c = v[seeds].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        fresh = np.stack([v[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = fresh / np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents by dimension) over all rows of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIM, np.int64)
        for b in batches:
            n += b.num_rows
            for _, _, c in counts(b.column(0)):
                df += (c > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(DIM)], pa.int32()), pa.array([n, *df.tolist()], pa.int64())], ["dim", "n"])

    rows = texts.select("text").mapInArrow(tidy(run), "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    found = {r["dim"]: r["n"] for r in rows}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(DIM)], np.float64)


def fit(train: DataFrame, sample: int = SAMPLE, per_language: int = CENTROIDS) -> Model:
    """``train`` (text, lang), one row per document -> a model."""
    train = train.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    hashed = train.select("lang", F.xxhash64("text", F.lit("sample")).alias("h"))
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one number per language
    if not sizes:
        return Model()
    total, df = document_frequencies(train)
    m = Model(languages=sorted(sizes), idf=(np.log((total + 1) / (df + 1)) + 1).astype(np.float32))
    share = max(LEAST, sample // len(sizes))
    # different texts by hash: a multiple of the share is drawn, then cut to it
    rate = F.broadcast(train.sparkSession.createDataFrame([(k, min(1.0, 4 * share / max(n, 1))) for k, n in sizes.items()], "lang string, rate double"))
    drawn = hashed.join(rate, "lang").where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < F.col("rate")).select("lang", "h").distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    keys = saved(drawn.withColumn("turn", turn).where(F.col("turn") <= share).select("lang", "h"), "langid-sample", True)
    # at most max(SAMPLE, LEAST x languages) rows of two short columns: a bounded broadcast
    picked = train.withColumn("h", F.xxhash64("text", F.lit("sample"))).join(F.broadcast(keys), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, values = [], []
            for _, _, c in counts(b.column(1)):
                for row in c:
                    at = np.flatnonzero(row)
                    dims.append(at.astype("<u2").tobytes())
                    values.append(np.minimum(row[at], 1 << 30).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.binary()), pa.array(values, pa.binary())], ["lang", "dims", "counts"])

    rows = picked.select("lang", "text").mapInArrow(tidy(run), "lang string, dims binary, counts binary").collect()
    groups: dict[str, list[tuple[bytes, bytes]]] = {}
    while rows:
        r = rows.pop()
        groups.setdefault(r["lang"], []).append((bytes(r["dims"]), bytes(r["counts"])))
    m.languages = sorted(groups)
    owner, centers, floor = [], [], []
    for i, lang in enumerate(m.languages):  # one language's rows at a time are written out
        own = np.zeros((len(groups[lang]), DIM), np.float32)
        for k, (dims, uses) in enumerate(sorted(groups.pop(lang))):
            own[k, np.frombuffer(dims, "<u2")] = np.frombuffer(uses, "<u4")
        c = spherical_kmeans(m.vectors(own), per_language)
        owner += [i] * len(c)
        centers.append(c)
        floor.append(usual(m, own, c))
    m.owner, m.centroids, m.floor = np.array(owner), np.concatenate(centers), FAR * np.array(floor)
    drop_saved(keys)
    give_back()
    return m


def usual(m: Model, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosine that 19 of 20 texts reach, by number of n-grams: rows of counts are thinned to each size."""
    rng, out = np.random.default_rng(0), []
    at, n = np.nonzero(rows), rows.sum(1)
    uses = rows[at].astype(np.int64)
    thin = np.zeros_like(rows)
    for size in THIN:
        thin[at] = rng.binomial(uses, np.minimum(1.0, size / np.maximum(n, 1))[at[0]])
        out.append(float(np.quantile((m.vectors(thin) @ centroids.T).max(1), 0.05)))
    return np.array(out)


def has_letter(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def judge_column(model: Model, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, cosine, rejected) of a text column."""
    letter = has_letter(col)
    at, score, cos, out = (np.zeros(len(col), t) for t in (np.int64, float, float, bool))
    for lo, hi, c in counts(col):
        at[lo:hi], score[lo:hi], cos[lo:hi], out[lo:hi] = model.judge(c)
    known = letter & bool(model.languages)
    names = [model.languages[a] if k else UNKNOWN for a, k in zip(at, known, strict=True)]
    return names, np.clip(np.where(known, score, 0.0), 0, 1), np.where(known, cos, 0.0), out | ~known


def identify(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, held_out, lang_pred, score, cosine, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, cos, out = judge_column(model, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(cos), pa.array(out)], ["doc_id", "held_out", "lang_pred", "score", "cosine", "rejected"])

    source = docs.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(tidy(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, cosine double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~judge_column(model, b.column(at))[3]))

    return docs.mapInArrow(tidy(run), docs.schema)
