"""Toxicity by the nearest labelled examples.

Terms are lower-cased words and their leading bytes, which catch inflected forms
of one stem.  Texts and examples are TF-IDF vectors over all terms that enough
examples have; document frequencies count all documents.  As a text's few
telling words would drown among hundreds of others, each weight is also
multiplied by ``FLOOR`` plus the term's association with the label among the
examples, chi-square over chi-square plus ``HALF``: no term is left out.

A block-max inverted index over the examples gives the exact nearest ones by
cosine: examples of like texts share a block of ``BLOCK``; each term has its
postings and its largest weight for every block; the sum of these bounds a
block's best cosine.  A text's best blocks by bound are scored first, and then
all others whose bound can still beat the k-th best.  Votes weighted by
closeness, each example weighing as many rows as it stands for, give a share; a
logistic curve through the shares that examples get from the others turns it
into a calibrated score.  The nearest examples are its evidence.

The classifier (terms, weights, examples, curve) is fitted on at most ``SAMPLE``
labelled training rows, a third of them toxic where there are so many; every
text is then scored whole.

Defined results: null and empty texts, and texts without a known term, get the
rate of the label among training rows; texts of any length are scored whole;
without training rows every score is 0; an id with several labels counts as
toxic if one says so, labels of null ids are ignored, and where an id has several
texts the first by digest is the example; repeated rows are scored alike; ties
between neighbours go to the smaller example number; an empty table gives no
rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import drop_saved, saved, tidy

#: Labelled rows that the classifier is fitted on, at most; neighbours; examples per block; blocks that are scored first.
SAMPLE, NEIGHBOURS, BLOCK, FIRST = 1536, 15, 64, 2
#: Lengths in bytes of the leading parts of words that are terms too; examples that a term needs.
PREFIXES, MIN_EXAMPLES = (6,), 3
#: Weight of a term that has nothing to do with the label; chi-square of one that weighs half as much as the most telling ones.
FLOOR, HALF = 0.03, 100.0
THRESHOLD, CLOSENESS = 0.3, 2.0
#: Texts that are scored together; pairs of a text and a block whose postings are added together (few enough for a cache).
_ROWS, _PAIRS = 128, 32

_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True
_VALUES = K.byte_values(True, _SOLID)


def chunk_terms(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document index, term) of every word from its first letter or digit on, and of its leading bytes.

    Leading bytes (``PREFIXES``) catch inflected forms of one stem.
    """
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, K.U64)
    place = np.where(_SOLID[w.raw], np.arange(len(w.raw)), len(w.raw))
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    origin = np.minimum(nearest[w.start], w.end - 1)
    ok = _SOLID[w.raw[origin]]
    origin, end, doc = origin[ok], w.end[ok], w.doc[ok]
    total = K.byte_sums(w.raw, _VALUES)
    docs, terms = [doc], [K.span_hashes(total, origin, end)]
    for n in PREFIXES:
        long = end - origin > n
        docs.append(doc[long])
        terms.append(K.mix64(K.span_hashes(total, origin[long], origin[long] + n) + K.U64(n)))
    return np.concatenate(docs), np.concatenate(terms)


def counted(col: pa.Array, terms: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end, text of each entry, term number, uses) of the known ``terms``, a few texts at a time."""
    raw, off = K.string_parts(col)
    for lo, hi in K.chunks(off):
        doc, h = chunk_terms(K.split_words(raw, off, lo, hi))
        at = np.searchsorted(terms, h)
        at[at == len(terms)] = 0
        hit = terms[at] == h if len(terms) else np.zeros(len(h), bool)
        pair, uses = np.unique(doc[hit] * max(len(terms), 1) + at[hit], return_counts=True)
        doc, term = np.divmod(pair, max(len(terms), 1))
        for i in range(0, hi - lo, _ROWS):
            x, y = np.searchsorted(doc, [i, min(i + _ROWS, hi - lo)])
            yield lo + i, min(lo + i + _ROWS, hi), doc[x:y] - i, term[x:y], uses[x:y]


def unit(doc: np.ndarray, uses: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Entries of TF-IDF vectors of length 1; ``weight`` is the term's."""
    v = (1 + np.log(uses)) * weight
    norm = np.sqrt(np.bincount(doc, v * v, n))
    return v / np.maximum(norm, 1e-12)[doc]


@dataclass
class Index:
    """Postings and largest weights of every term in every block of examples."""

    start: np.ndarray  # block x term: place of its postings; one entry more than cells
    example: np.ndarray  # number of the example within its block
    value: np.ndarray
    top: np.ndarray  # term x block

    @staticmethod
    def of(doc: np.ndarray, term: np.ndarray, v: np.ndarray, n: int, terms: int) -> Index:
        blocks = -(-n // BLOCK)
        cell = doc // BLOCK * terms + term
        order = np.argsort(cell, kind="stable")
        top = np.zeros(blocks * terms, np.float32)
        np.maximum.at(top, cell, np.nextafter(v.astype(np.float32), np.float32(2)))
        start = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=blocks * terms)))).astype(np.int32)
        return Index(start, (doc % BLOCK)[order].astype(np.int8), v[order], np.ascontiguousarray(top.reshape(blocks, terms).T))

    def cosines(self, text: np.ndarray, block: np.ndarray, first: np.ndarray, term: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Cosines of texts with all examples of blocks, pair by pair; ``first`` tells a text's entries."""
        return np.concatenate([self._cosines(text[i : i + _PAIRS], block[i : i + _PAIRS], first, term, q) for i in range(0, len(text), _PAIRS)])

    def _cosines(self, text: np.ndarray, block: np.ndarray, first: np.ndarray, term: np.ndarray, q: np.ndarray) -> np.ndarray:
        size = np.diff(first)[text]
        pair = np.repeat(np.arange(len(text)), size)
        entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[text], size)
        cell = block[pair] * np.int64(self.top.shape[0]) + term[entry]
        lo = self.start[cell]
        many = self.start[cell + 1] - lo
        live = np.flatnonzero(many)
        lo, many = lo[live].astype(np.int64), many[live]
        on = np.repeat(np.arange(len(live), dtype=np.int32), many)
        place = np.arange(len(on)) + (lo - (np.cumsum(many) - many))[on]
        slot = (pair[live] * BLOCK)[on]
        slot += self.example[place]
        share = q[entry[live]][on]
        share *= self.value[place]
        return np.bincount(slot, share, len(text) * BLOCK).reshape(-1, BLOCK)

    def nearest(self, doc: np.ndarray, term: np.ndarray, q: np.ndarray, n: int, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exact top-k (cosine, example) of ``n`` texts, entries in their order; -1 and 0 where there are fewer.  ``skip``: an example that a text may not have."""
        blocks = self.top.shape[1]
        best, who = np.zeros((n, k)), np.full((n, k), -1, np.int64)
        if not n or not blocks or not len(doc):
            return best, who
        first = np.searchsorted(doc, np.arange(n + 1))
        bound = np.zeros((n, blocks))
        some = np.flatnonzero(np.diff(first))
        bound[some] = np.add.reduceat(q[:, None] * self.top[term], first[some], axis=0)
        order = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
        due = np.zeros((n, blocks), bool)
        np.put_along_axis(due, order, True, 1)
        for turn in range(2):
            if turn:  # whatever can still enter
                due = ~due & (bound >= best[:, -1:] - 1e-9)
            text, block = np.nonzero(due & (bound > 0))
            if not len(text):
                continue
            cos = self.cosines(text, block, first, term, q)
            if skip is not None:
                cos[block[:, None] * BLOCK + np.arange(BLOCK) == skip[text][:, None]] = 0
            x, y = np.nonzero(cos > np.maximum(best[text, -1:] - 1e-9, 0))
            x, c, w = text[x], np.round(cos[x, y], 9), block[x] * BLOCK + y
            x, c, w = x[c > 0], c[c > 0], w[c > 0]
            old = np.nonzero(who >= 0)
            x, c, w = np.concatenate((x, old[0])), np.concatenate((c, best[old])), np.concatenate((w, who[old]))
            by = np.lexsort((w, -c, x))
            x, c, w = x[by], c[by], w[by]
            turn_in = np.arange(len(x)) - np.searchsorted(x, x)
            ok = turn_in < k
            best[x[ok], turn_in[ok]], who[x[ok], turn_in[ok]] = c[ok], w[ok]
        return best, who


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes
    weight: np.ndarray  # of each term: inverse document frequency and association
    index: Index | None
    toxic: np.ndarray  # of each example
    stands: np.ndarray  # rows that each example stands for
    ids: np.ndarray
    rate: float  # of the label among training rows
    curve: tuple[float, float] = (0.0, 1.0)  # of the share of votes, as logarithms of odds

    def share(self, cos: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Logarithm of the odds of the weighted votes, each label's rate of a tenth of a vote besides."""
        vote = np.where(who >= 0, cos**CLOSENESS * self.stands[who], 0)
        yes = (vote * self.toxic[who]).sum(1)
        return np.log(yes + 0.1 * self.rate) - np.log(vote.sum(1) - yes + 0.1 * (1 - self.rate))

    def score(self, doc: np.ndarray, term: np.ndarray, uses: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, neighbours, cosines) of ``n`` texts."""
        q = unit(doc, uses, self.weight[term], n)
        cos, who = self.index.nearest(doc, term, q, n, NEIGHBOURS)
        score = 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * self.share(cos, who))))
        return np.where(who[:, 0] >= 0, score, self.rate), who, cos


def fitted_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Logistic regression of ``y`` on ``x`` by Newton's method, with a small penalty on the slope."""
    a = np.stack((np.ones(len(x)), x), 1)
    c, ridge = np.zeros(2), np.diag([0.0, 1e-3 * w.sum()])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        grad = a.T @ (w * (y - p)) - ridge @ (c - [0.0, 1.0])
        step = np.linalg.solve((a * (w * p * (1 - p) + 1e-9 * w)[:, None]).T @ a + ridge, grad)
        c = c + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(c[0]), float(c[1])


def like_texts(doc: np.ndarray, term: np.ndarray, v: np.ndarray, n: int, terms: int) -> np.ndarray:
    """An order of the examples in which like ones are neighbours: by the nearest of a few centroids over the most used terms."""
    many = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:256]
    column = np.full(terms, -1)
    column[many] = np.arange(len(many))
    x = np.zeros((n, max(len(many), 1)))
    ok = column[term] >= 0
    x[doc[ok], column[term[ok]]] = v[ok]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[:: max(1, n // 32)][:32].copy()
    for _ in range(6):
        own = (x @ c.T).argmax(1)
        for k in range(len(c)):
            if (own == k).any():
                m = x[own == k].mean(0)
                c[k] = m / max(np.linalg.norm(m), 1e-12)
    near = x @ c.T
    return np.lexsort((np.arange(n), -near.max(1), near.argmax(1)))


def sample_terms(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, terms, counts of the sampled labelled texts; training rows by label), whole texts."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    one = saved(one, "tox-labels", True)
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = lambda y, n: one.where(F.col("toxic") == y).orderBy(F.xxhash64("_id", F.lit("sample")), "_id").limit(n)
    few = min(sizes.get(1, 0), max(sample // 3, sample - sizes.get(0, 0)))
    picked = saved(draw(1, few).union(draw(0, sample - few)), "tox-sample", True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, counts = [b""] * b.num_rows, [b""] * b.num_rows
            raw, off = K.string_parts(b.column(2))
            for lo, hi in K.chunks(off):
                doc, h = chunk_terms(K.split_words(raw, off, lo, hi))
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                start, size = K.group_spans(doc)
                for s, z in zip(start, size, strict=True):
                    u, c = np.unique(h[s : s + z], return_counts=True)
                    terms[lo + doc[s]], counts[lo + doc[s]] = u.astype("<u8").tobytes(), c.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "toxic", "terms", "counts"])

    # at most ``sample`` rows of two numbers: a bounded broadcast
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    joined = joined.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text"))["text"].alias("text"))
    rows = saved(joined.mapInArrow(tidy(run), "doc_id long, toxic int, terms binary, counts binary"), "tox-terms", True)
    drop_saved(one, picked)
    return rows, sizes


def document_frequencies(docs: DataFrame, terms) -> tuple[int, np.ndarray]:
    """(documents, documents by term) over all rows of ``docs`` (text), for the broadcast ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(terms.value), np.int64)
        for b in batches:
            n += b.num_rows
            for _, _, _, term, _ in counted(b.column(0), terms.value):
                df += np.bincount(term, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], n))], ["term", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = found["term"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(len(terms.value), np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs`` (doc_id, text) and training ``labels`` (doc_id, toxic) -> a model; ``sample`` bounds what the driver holds."""
    rows, sizes = sample_terms(docs, labels, sample)
    examples = sorted(rows.collect(), key=lambda r: (r["doc_id"], bytes(r["terms"]), bytes(r["counts"])))  # at most ``sample``
    drop_saved(rows)
    rate = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    hashes = [np.frombuffer(r["terms"], "<u8") for r in examples]
    doc = np.repeat(np.arange(len(examples)), [len(h) for h in hashes])
    terms, term, seen = np.unique(np.concatenate([*hashes, np.zeros(0, "<u8")]), return_inverse=True, return_counts=True)
    uses = np.concatenate([*(np.frombuffer(r["counts"], "<u4") for r in examples), np.zeros(0, "<u4")]).astype(np.int64)
    enough = seen >= MIN_EXAMPLES
    ok = enough[term]
    doc, term, uses = doc[ok], (np.cumsum(enough) - 1)[term[ok]], uses[ok]
    terms = terms[enough].astype(np.uint64)
    y = np.array([r["toxic"] for r in examples], float)
    if not len(doc):
        return Model(terms, np.zeros(len(terms)), None, y, y, np.zeros(0, np.int64), rate)
    total, df = document_frequencies(docs, docs.sparkSession.sparkContext.broadcast(terms))
    a, both = np.bincount(term, y[doc], len(terms)), np.bincount(term, minlength=len(terms))
    weight = np.log((total + 1) / np.minimum(df, total).clip(1)) * (FLOOR + association(a, both, y.sum(), len(y)))
    v = unit(doc, uses, weight[term], len(examples))
    order = like_texts(doc, term, v, len(examples), len(terms))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc = place[doc]
    by = np.lexsort((term, doc))
    doc, term, v = doc[by], term[by], v[by]
    stands = np.where(y == 1, sizes.get(1, 0) / max(y.sum(), 1), sizes.get(0, 0) / max((1 - y).sum(), 1))[order]
    m = Model(terms, weight, Index.of(doc, term, v, len(order), len(terms)), y[order], stands, np.array([r["doc_id"] for r in examples], np.int64)[order], rate)
    own = []
    for i in range(0, len(order), _ROWS):  # each example by the others
        x, z = np.searchsorted(doc, [i, i + _ROWS])
        n = min(_ROWS, len(order) - i)
        own.append(m.share(*m.index.nearest(doc[x:z] - i, term[x:z], v[x:z], n, NEIGHBOURS, np.arange(i, i + n))))
    m.curve = fitted_curve(np.concatenate(own), m.toxic, stands)
    return m


def association(a: np.ndarray, both: np.ndarray, toxic: float, total: int) -> np.ndarray:
    """0 to 1: how much a term, in ``a`` toxic ones of ``both`` examples, tells about the label (chi-square, corrected for continuity)."""
    b = both - a
    c, d = toxic - a, (total - toxic) - b
    chi = total * np.maximum(np.abs(a * d - b * c) - total / 2, 0) ** 2 / np.maximum(both * (c + d) * toxic * (total - toxic), 1e-9)
    return chi / (chi + HALF)


def score(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, held_out, score, predicted, evidence (nearest example ids), closeness."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            n = b.num_rows
            out, who, cos = np.full(n, m.rate), np.full((n, 3), -1, np.int64), np.zeros(n)
            for lo, hi, doc, term, uses in counted(b.column(2), m.terms) if m.index else ():
                s, w, x = m.score(doc, term, uses, hi - lo)
                out[lo:hi], who[lo:hi], cos[lo:hi] = s, w[:, :3], x[:, 0]
            names = [[int(m.ids[j]) for j in r if j >= 0] for r in who]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.clip(out, 0, 1)), pa.array((out >= THRESHOLD).astype(np.int32)), pa.array(names, pa.list_(pa.int64())), pa.array(cos)], ["doc_id", "held_out", "score", "predicted", "evidence", "closeness"])

    source = docs.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(tidy(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, evidence array<long>, closeness double")
