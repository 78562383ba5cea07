"""Language-model scoring by the likelihood of a subword lattice.

The pieces are those of an existing vocabulary; its scores (ranks) give the
first weights of a unigram model over pieces and an end symbol.  A word's
probability is the sum over all its segmentations of the product of its pieces'
probabilities, found by a forward recursion in log space.  Pieces never cross
white space, so a text's marginal probability is the product over its words and
one end symbol, and the score is its logarithm to base 10.

Learning is a documented step of its own: ``ROUNDS`` rounds of expectation
maximisation over the training words, each weighted by its number of tokens,
turn the vocabulary's scores into those under which the training texts are
likelier.  Nothing but the pieces' probabilities is learnt for the score.

Each distinct word of the corpus goes through the lattice once.  Words are
grouped by hash into slices; a slice's words, counts and log-probabilities are
one row.  The most frequent words form a table of at most ``COMMON`` entries
that every task may hold; the other tokens meet their slice in a shuffle.

Defined results: null and empty texts are the end symbol alone; texts of any
length are scored whole, a word of any length too; characters outside the
vocabulary are spelt by its byte pieces; without training rows nothing is known
and the first weights are used, the end symbol counting as one more piece of
equal weight; rows that repeat an id, or have none, are scored each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import drop_saved, keyed, plain_ids, saved, tidy

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Slices of the words; entries of the common table; rounds of training; weight of a piece that was never expected.
SLICES, COMMON, ROUNDS, FLOOR = 1024, 1 << 19, 2, 0.1
_SPACE = "▁".encode()
_BLOCK = 16384
#: Words of more bytes, and blocks of fewer words, go word by word, in stretches of so many positions.
_LONG, _FEW, _STRETCH = 256, 16, 4096
_BINS = 64
#: Words that are held before contributions to a slice are merged; words that a task gathers before it sends them.
_MERGE, _SEND = 100_000, 400_000


class Slots:
    """Finds 64-bit keys: two direct tables by different bits; keys that fit in neither are left out of ``held``."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.shift, self.mask = keys, K.U64(64 - bits), K.U64((1 << bits) - 1)
        self.one, self.two = np.full(1 << bits, -1, np.int32), np.full(1 << bits, -1, np.int32)
        at = np.arange(len(keys), dtype=np.int32)
        self.one[(keys >> self.shift).astype(np.int64)] = at
        left = at[self.one[(keys >> self.shift).astype(np.int64)] != at]
        self.two[(keys[left] & self.mask).astype(np.int64)] = left
        self.held = self.find(keys) >= 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        a = self.one[(h >> self.shift).astype(np.int64)]
        a = np.where((a >= 0) & (self.keys[a] == h), a, np.int32(-1))
        miss = np.flatnonzero(a < 0)
        b = self.two[(h[miss] & self.mask).astype(np.int64)]
        a[miss] = np.where((b >= 0) & (self.keys[b] == h[miss]), b, np.int32(-1))
        return a


@functools.cache
def pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """(bytes of each usable piece, its first log-weight); byte pieces come last, least likely."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        p = sp.id_to_piece(i).encode()
        if _SPACE in p[1:] and p != _SPACE:
            continue  # holds white space inside; no word does
        found[p] = -math.log(2 - sp.get_score(i))
    least = min(found.values(), default=0.0)
    for b in range(256):
        found.setdefault(bytes([b]), least)
    names = list(found)
    w = np.array([found[p] for p in names])
    return names, w - np.logaddexp.reduce(w)


@functools.cache
def lattice(path: str) -> tuple[Slots, int]:
    names, _ = pieces(path)
    data, size = b"".join(names), np.array([len(p) for p in names])
    raw = np.frombuffer(data, np.uint8)
    start = np.cumsum(size) - size
    slots = Slots(K.span_hashes(K.byte_sums(raw), start, start + size), 20)
    if not slots.held.all():
        raise ValueError("two pieces cannot be told apart in the table")
    return slots, int(size.max())


def _edges(block: np.ndarray, slots: Slots, longest: int) -> list[list[tuple[int, np.ndarray]]]:
    """For each end position, (length, piece of every word or -1) of the lengths that some word has."""
    m, n = block.shape
    power, inverse = K._power_tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros((n + 1, m), K.U64)
        np.cumsum(K.PLAIN[block.T] * power[:n, None], axis=0, out=total[1:])
        out = []
        for e in range(1, n + 1):
            here = []
            for size in range(1, min(e, longest) + 1):
                at = slots.find(K.mix64((total[e] - total[e - size]) * inverse[e - size]))
                if (at >= 0).any():
                    here.append((size, at))
            out.append(here)
    return out


def _step(terms: list[np.ndarray], m: int) -> np.ndarray:
    """log of the sum of exponentials, row-wise over a list."""
    if not terms:
        return np.full(m, -np.inf)
    x = np.stack(terms)
    top = x.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(0))


def forward(block: np.ndarray, logp: np.ndarray, slots: Slots, longest: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(log-probability of each word, expected uses of each piece) for words of one length.

    ``block`` has a word's bytes per row.  With ``counts``, a backward pass
    gives every piece's expected number of uses, weighted by the words' counts.
    """
    m, n = block.shape
    if n > _LONG or m < _FEW:
        each = [_long_word(row, logp, slots, longest, None if counts is None else counts[i]) for i, row in enumerate(block)]
        return np.array([x[0] for x in each]), None if counts is None else sum(x[1] for x in each)
    edges = _edges(block, slots, longest)
    weight = np.append(logp, -np.inf)  # index -1: no piece
    alpha = [np.zeros(m)]
    for e in range(1, n + 1):
        alpha.append(_step([alpha[e - size] + weight[at] for size, at in edges[e - 1]], m))
    if counts is None:
        return alpha[n], None
    beta: list[list[np.ndarray]] = [[] for _ in range(n)] + [[np.zeros(m)]]
    uses = np.zeros(len(logp))
    for e in range(n, 0, -1):
        after = beta[e][0] if e == n else _step(beta[e], m)
        for size, at in edges[e - 1]:
            on = weight[at] + after
            beta[e - size].append(on)
            hit = at >= 0
            share = np.exp(alpha[e - size][hit] + on[hit] - alpha[n][hit]) * counts[hit]
            uses += np.bincount(at[hit], share, len(logp))
        beta[e] = []
    return alpha[n], uses


def _long_word(word: np.ndarray, logp: np.ndarray, slots: Slots, longest: int, count: float | None) -> tuple[float, np.ndarray | None]:
    """``forward`` for one long word: pieces of a stretch of end positions are found together."""
    n = len(word)
    total, weight = K.byte_sums(word), np.append(logp, -np.inf)
    sizes = np.arange(1, longest + 1)

    def stretch(lo: int, hi: int) -> np.ndarray:
        """Piece of each (end position, length) for ends from ``lo`` to ``hi`` (exclusive), or -1."""
        end = np.arange(lo, hi)[:, None]
        start = end - sizes
        ok = start >= 0
        out = np.full(start.shape, -1, np.int32)
        out[ok] = slots.find(K.span_hashes(total, start[ok], np.broadcast_to(end, start.shape)[ok]))
        return out

    pad = np.full(longest, -np.inf)
    alpha = np.concatenate((pad, [0.0], np.full(n, -np.inf)))  # alpha[longest + e]
    for lo in range(1, n + 1, _STRETCH):
        w = weight[stretch(lo, min(lo + _STRETCH, n + 1))]
        for e, row in enumerate(w, lo):
            x = alpha[e : e + longest][::-1] + row
            top = x.max()
            alpha[longest + e] = top + np.log(np.exp(x - top).sum()) if np.isfinite(top) else -np.inf
    if count is None:
        return float(alpha[longest + n]), None
    beta = np.concatenate((pad, np.full(n, -np.inf), [0.0]))  # beta[longest + e], filled from the end
    uses = np.zeros(len(logp))
    for lo in reversed(range(1, n + 1, _STRETCH)):
        at = stretch(lo, min(lo + _STRETCH, n + 1))
        w = weight[at]
        for e in range(lo + len(w) - 1, lo - 1, -1):
            into = beta[e : e + longest]
            np.logaddexp(into, w[e - lo][::-1] + beta[longest + e], out=into)
        start = np.arange(lo, lo + len(w))[:, None] - sizes
        hit = at >= 0
        share = alpha[longest + start[hit]] + w[hit] + np.broadcast_to(beta[longest + lo : longest + lo + len(w), None], at.shape)[hit] - alpha[longest + n]
        uses += np.bincount(at[hit], np.exp(share) * count, len(logp))
    return float(alpha[longest + n]), uses


def gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of many spans, one after the other."""
    return raw[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def by_length(raw: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, byte matrix with the space mark in front) of words of equal length, in blocks."""
    start = np.cumsum(size) - size
    order = np.argsort(size, kind="stable")
    first, many = K.group_spans(size[order])
    mark = np.frombuffer(_SPACE, np.uint8)
    for f, k in zip(first, many, strict=True):
        n = int(size[order[f]])
        step = max(1, min(_BLOCK, (1 << 22) // (n + 3)))
        for i in range(f, f + k, step):
            at = order[i : min(i + step, f + k)]
            block = np.empty((len(at), n + 3), np.uint8)
            block[:, :3] = mark
            block[:, 3:] = raw[start[at][:, None] + np.arange(n)]
            yield at, block


TYPES = "slice int, hash binary, train binary, size binary, bytes binary"


def _u8(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint8)


def _array(x, kind: str) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def word_types(docs: DataFrame) -> DataFrame:
    """One row per slice: the corpus's distinct words, their counts in training texts and their bytes."""

    def rows(h, train, size, data) -> pa.RecordBatch:
        """Slices of words sorted by hash."""
        cut = np.searchsorted(h >> K.U64(54), np.arange(SLICES + 1, dtype=K.U64))
        byte = np.concatenate(([0], np.cumsum(size)))
        some = [i for i in range(SLICES) if cut[i + 1] > cut[i]]
        col = lambda x, kind: pa.array([x[cut[i] : cut[i + 1]].astype(kind).tobytes() for i in some], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), col(h, "<u8"), col(train, "<i8"), col(size, "<u4"), pa.array([data[byte[cut[i]] : byte[cut[i + 1]]].tobytes() for i in some], pa.binary())], ["slice", "hash", "train", "size", "bytes"])

    def merge(parts: list[tuple]) -> tuple:
        h, train, size, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        start = np.cumsum(size) - size
        return u, np.bincount(back, train, len(u)).astype(np.int64), size[first], gather(data, start[first], size[first])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for b in batches:
            raw, off = K.string_parts(b.column(0))
            learn = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in K.chunks(off, 4 * K.CHUNK_BYTES):
                w = K.split_words(raw, off, lo, hi)
                h = K.word_hashes(w, K.LOWER)
                u, first, back = np.unique(h, return_index=True, return_inverse=True)
                train = np.bincount(back, learn[lo:hi][w.doc], len(u)).astype(np.int64)
                size = (w.end - w.start)[first]
                data = gather(w.raw, w.start[first], size)
                parts.append((u, train, size, np.where((data >= 65) & (data <= 90), data + 32, data)))
                if sum(len(p[0]) for p in parts) > _SEND:
                    parts = [merge(parts)]
                    if len(parts[0][0]) > _SEND // 2:
                        yield rows(*parts.pop())
        if parts:
            yield rows(*merge(parts))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            for k, i in enumerate(b.column(0).to_pylist()):
                if held and i != at:
                    yield rows(*merge(held))
                    held = []
                at = i
                held.append((_array(b.column(1)[k], "<u8"), _array(b.column(2)[k], "<i8"), _array(b.column(3)[k], "<u4").astype(np.int64), _u8(b.column(4)[k])))
                if len(held) > 8 and sum(len(x[0]) for x in held[1:]) > max(_MERGE, len(held[0][0])):
                    held = [merge(held)]  # at most twice the slice's distinct words are held
        if held:
            yield rows(*merge(held))

    sent = docs.select("text", "learn").mapInArrow(tidy(collect), TYPES)
    return sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(tidy(unite), TYPES)


@dataclass
class Counts:
    tokens: int  # training tokens, ends included
    types: int  # distinct ones
    texts: int  # training texts, so many ends

    @property
    def base(self) -> float:
        return self.tokens + self.types + 1


def joined_rows(batches: Iterator[pa.RecordBatch], size_col: int, words: int = 150_000) -> Iterator[list[tuple]]:
    """Rows of types in lists of about ``words`` words: few, long blocks suit array operations."""
    held, n = [], 0
    for b in batches:
        for row in zip(*b.columns, strict=True):
            held.append(row)
            n += row[size_col].as_buffer().size // 4
            if n >= words:
                yield held
                held, n = [], 0
    if held:
        yield held


def expected_uses(types: DataFrame, logp, vocabulary: str) -> np.ndarray:
    """Expected uses of each piece in the training texts: each distinct word once, weighted by its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, longest = lattice(vocabulary)
        uses = np.zeros(len(logp.value))
        for rows in joined_rows(batches, 2):
            train, size, raw = (np.concatenate(x) for x in zip(*[(_array(r[1], "<i8"), _array(r[2], "<u4").astype(np.int64), _u8(r[3])) for r in rows], strict=True))
            live = train > 0
            weight = train[live].astype(float)
            raw = gather(raw, (np.cumsum(size) - size)[live], size[live])
            for at, block in by_length(raw, size[live]):
                uses += forward(block, logp.value, slots, longest, weight[at])[1]
        some = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(uses[some])], ["piece", "uses"])

    found = types.select("slice", "train", "size", "bytes").mapInArrow(tidy(run), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
    out = np.zeros(len(logp.value))
    out[found["piece"].to_numpy()] = found["uses"].to_numpy()
    return out


def scored_types(types: DataFrame, logp, vocabulary: str) -> DataFrame:
    """(slice, hash, train, lp): log-probability of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, longest = lattice(vocabulary)
        for rows in joined_rows(batches, 3):
            sizes = [_array(r[3], "<u4").astype(np.int64) for r in rows]
            size, raw = np.concatenate(sizes), np.concatenate([_u8(r[4]) for r in rows])
            lp = np.zeros(len(size), "<f8")
            for at, block in by_length(raw, size):
                lp[at] = forward(block, logp.value, slots, longest)[0]
            parts = np.split(lp, np.cumsum([len(x) for x in sizes])[:-1])
            col = lambda k: pa.array([r[k].as_py() for r in rows], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array([r[0].as_py() for r in rows], pa.int32()), col(1), col(2), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "hash", "train", "lp"])

    return types.mapInArrow(tidy(run), "slice int, hash binary, train binary, lp binary")


def tallies(types: DataFrame) -> list[tuple[int, int, int]]:
    """(bin of the count's logarithm, words in it, their uses); at most 64 * 64 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(64 * _BINS, np.int64), np.zeros(64 * _BINS, np.int64)
        for b in batches:
            for x in b.column(0):
                c = _array(x, "<i8")
                c = c[c > 0]
                at = bin_of(c)
                n += np.bincount(at, minlength=len(n))
                np.add.at(s, at, c)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(s[some])], ["bin", "n", "uses"])

    rows = types.select("train").mapInArrow(tidy(run), "bin int, n long, uses long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")).collect()
    return sorted((r["bin"], r["n"], r["uses"]) for r in rows)


def bin_of(counts: np.ndarray) -> np.ndarray:
    return (np.log2(np.maximum(counts, 1)) * _BINS).astype(np.int64)


def common_words(table: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, train count, lp) of the words from a bin on; the caller has checked their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                h, c, lp = _array(b.column(0)[k], "<u8"), _array(b.column(1)[k], "<i8"), _array(b.column(2)[k], "<f8")
                ok = (c > 0) & (bin_of(c) >= least)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array([x[ok].tobytes()], pa.binary()) for x in (h, c, lp)], ["hash", "train", "lp"])

    rows = table.select("hash", "train", "lp").mapInArrow(tidy(run), "hash binary, train binary, lp binary").collect()
    join = lambda name, kind: np.frombuffer(b"".join(bytes(r[name]) for r in rows), kind)
    return join("hash", "<u8"), join("train", "<i8"), join("lp", "<f8")


PARTS = "slice int, kind int, a binary, b binary, c binary, doc_id long, n_tokens long, n_known long, base double, lp double"


def score(docs: DataFrame, learn: Column, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).

    Texts where ``learn`` is true train the model; all are scored.
    """
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    if plain_ids(docs):
        return _score(source.withColumn("doc_id", F.col("doc_id").cast("long")), vocabulary, rounds)
    rows = keyed(source, "lm-rows")
    found = _score(rows.select(F.col("key").alias("doc_id"), "row.text", "row.learn"), vocabulary, rounds).withColumnRenamed("doc_id", "key")
    ids = rows.select("key", F.col("row.doc_id").cast("long").alias("doc_id"))
    return found.join(ids, "key").select("doc_id", *[c for c in found.columns if c != "key"])


def _score(docs: DataFrame, vocabulary: str, rounds: int) -> DataFrame:
    """``score`` of rows (doc_id, text, learn) that each have an id of their own."""
    sc = docs.sparkSession.sparkContext
    types = saved(word_types(docs), "lm-types")
    texts = docs.where("learn").count()
    bins = tallies(types)
    n = Counts(sum(b[2] for b in bins) + texts, sum(b[1] for b in bins) + (texts > 0), texts)
    _, logp = pieces(vocabulary)
    end = -math.log(len(logp) + 1)
    for _ in range(rounds if texts else 0):
        uses = expected_uses(types, sc.broadcast(logp), vocabulary) + FLOOR
        logp, end = np.log(uses / (uses.sum() + texts)), math.log(texts / (uses.sum() + texts))
    table = saved(scored_types(types, sc.broadcast(logp), vocabulary), "lm-table")
    drop_saved(types)
    least, held = 64 * _BINS, 0
    for b, k, _ in reversed(bins):
        if held + k > COMMON:
            break
        least, held = b, held + k
    shared = sc.broadcast(common_words(table, least))
    d, end_base = n.base, math.log10((texts + 1) / n.base)

    def sums(doc, known, base, lp, rows) -> tuple:
        return np.bincount(doc, known, rows).astype(np.int64), np.bincount(doc, base, rows), np.bincount(doc, lp, rows)

    def empty(k: int) -> list[pa.Array]:
        return [pa.nulls(k, t) for t in (pa.binary(), pa.binary(), pa.binary())]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, train, lp = shared.value
        slots = Slots(keys, 22)
        base = np.log10((train + 1) / d)
        names = ["slice", "kind", "a", "b", "c", "doc_id", "n_tokens", "n_known", "base", "lp"]
        for b in batches:
            ids = b.column(0).to_numpy()
            raw, off = K.string_parts(b.column(1))
            rare_h, rare_d = [], []
            for lo, hi in K.chunks(off):
                w = K.split_words(raw, off, lo, hi)
                h = K.word_hashes(w, K.LOWER)
                at = slots.find(h)
                hit = at >= 0
                rare_h.append(h[~hit])
                rare_d.append(ids[lo:hi][w.doc[~hit]])
                at, doc, m = at[hit], w.doc[hit], hi - lo
                known, x, y = sums(doc, None, base[at], lp[at], m)
                own = ids[lo:hi]
                part = ((own.view(K.U64) * K.U64(0x9E3779B97F4A7C15)) >> K.U64(54)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(m, np.int32)), *empty(m), pa.array(own), pa.array(w.counts + 1), pa.array(known + (texts > 0)), pa.array(x + end_base), pa.array(y + end)], names)
            if rare_h:
                h, doc = np.concatenate(rare_h), np.concatenate(rare_d)
                order = np.argsort(h)
                h, doc = h[order].astype("<u8"), doc[order].astype("<i8")
                cut = np.searchsorted(h >> K.U64(54), np.arange(SLICES + 1, dtype=K.U64))
                some = [i for i in range(SLICES) if cut[i + 1] > cut[i]]
                k = len(some)
                col = lambda v: pa.array([v[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(k, 2, np.int32)), col(h), col(doc), pa.nulls(k, pa.binary()), *[pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_tokens", "n_known", "base", "lp"]
        at, keys = -1, np.zeros(0, "<u8")
        for b in batches:
            kind = b.column(1).to_numpy()
            done = b.filter(pa.array(kind == 0))
            if done.num_rows:
                yield done.select(names)
            b = b.filter(pa.array(kind > 0))
            for k, (i, what) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if what == 1:
                    at, keys, train, lp = i, _array(b.column(2)[k], "<u8"), _array(b.column(3)[k], "<i8"), _array(b.column(4)[k], "<f8")
                    base = np.log10((train + 1) / d)
                    continue
                h, doc = _array(b.column(2)[k], "<u8"), _array(b.column(3)[k], "<i8")
                if i != at:
                    raise ValueError("a slice's words are missing")
                own, back = np.unique(doc, return_inverse=True)
                j = np.searchsorted(keys, h)
                known, x, y = sums(back, (train[j] > 0).astype(float), base[j], lp[j], len(own))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(own), np.int64)), pa.array(known), pa.array(x), pa.array(y)], names)

    null = lambda *cols: [F.lit(None).cast(t).alias(c) for c, t in cols]
    words = table.select("slice", F.lit(1).alias("kind"), F.col("hash").alias("a"), F.col("train").alias("b"), F.col("lp").alias("c"), *null(("doc_id", "long"), ("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("lp", "double")))
    met = docs.select("doc_id", "text").mapInArrow(tidy(look), PARTS).union(words).repartition("slice").sortWithinPartitions("slice", "kind")
    parts = met.mapInArrow(tidy(meet), "doc_id long, n_tokens long, n_known long, base double, lp double")
    out = parts.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), (F.sum("lp") / math.log(10)).alias("score"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n.tokens).cast("long").alias("train_tokens"), "base_score", "score")
