"""Substring deduplication by prefix-partitioned suffix trees.

A window is ``width`` consecutive words of one document; every window whose
words also start earlier (smaller id, or earlier in the same document) is a
repeat, and all words under repeats are removed.

Texts that equal an earlier one are settled by their digest.  Of the others,
each window is led by an anchor, the smallest of its 8-word grams by hash;
equal windows have equal anchors.  Windows whose anchor occurs once cannot
repeat; the others go on as suffixes, neighbouring ones with the same anchor in
one row.  Suffixes are split by a prefix of the anchor's text, as short as
keeps the group within ``GROUP`` anchors: 2, 4 or 8 words.  Each such group is
turned into its suffix tree: suffixes in order, with the length that each has in
common with the one before it.  An internal node is a run of suffixes with a
common length; the shallowest ones of ``width`` words or more are the repeats,
with all that lie deeper among their leaves, and all leaves but the earliest are
marked.  Where even 8 words are too frequent the prefix is the whole window: the
group is then a single node, whose leaves stream past in order, so no group has
to fit in memory that is not within ``GROUP``.

Copies of one row of windows within a batch travel once; the rest are marked
where they are.  So a passage that a third of all documents share reaches its
group once per batch.

Defined results: null and empty texts have no words and keep the empty string;
texts of any length are treated whole; texts with fewer words than a window keep
all; rows without an id are documents of their own that come last; rows that
repeat an id and text are one document; rows that share an id with other texts
are documents of their own, in the order of their texts' digests; an empty table
gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import drop_saved, keyed, plain_ids, saved, tidy
from .filters import contains, id_hash, members, repeated
from .prefix import ranged_prefix

#: Words of a window and of an anchor; anchors of a group that is not split further.
WIDTH, ANCHOR, GROUP = 20, 8, 50_000
LEVELS = (2, 4, 8)
#: Counters per prefix length, as a power of two: so many at least and at most, and bytes of text for each in between.
COUNTER_BITS, COUNTER_BYTES = (16, 20), 1 << 14
#: Words of suffix rows that are handled together in one task.
_BATCH_WORDS = 500_000
#: Documents that are handled together.
_ROWS = 1000


def anchors(h: np.ndarray, w: K.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, anchor of each window, anchor grams)."""
    starts = K.windows_inside(w, width)
    grams = K.gram_hashes(h, ANCHOR)
    if not len(starts):
        return starts, starts, grams
    best, lag = grams[starts].copy(), np.zeros(len(starts), np.int64)
    for k in range(1, width - ANCHOR + 1):
        other = grams[starts + k]
        less = other < best
        np.copyto(best, other, where=less)
        lag[less] = k
    return starts, starts + lag, grams


def _changes(*keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _prefixes(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [K.gram_hashes(h, n)[at] for n in LEVELS]


def _pack(lists: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array of consecutive runs of 64-bit values."""
    off = np.concatenate(([0], np.cumsum(lengths * 8))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(lists.astype("<u8").tobytes())])


#: Applies a function over record batches of (doc_id, text) to all documents in question: (function, schema) -> rows.
Each = Callable[[Callable, str], DataFrame]


def anchor_counts(each: Each, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap of repeated anchors, anchors by prefix length and leading ``bits`` of the prefix's hash)."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LEVELS), size), np.int64)
        for b in batches:
            raw, off = K.string_parts(b.column(1))
            grams = []
            for lo, hi in K.chunks(off):
                w = K.split_words(raw, off, lo, hi)
                h = K.word_hashes(w)
                _, at, g = anchors(h, w, width)
                at = at[_changes(at)] if len(at) else at
                grams.append(g[at])
                for level, p in enumerate(_prefixes(h, at)):
                    counts[level] += np.bincount((p >> K.U64(64 - bits)).astype(np.int64), minlength=size)
            data = np.concatenate([*grams, np.zeros(0, K.U64)])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([data.astype("<u8").tobytes()], pa.binary())], ["kind", "data"])
        rows = [x for level in counts for x in np.split(level, 16)]
        yield pa.RecordBatch.from_arrays([pa.array(range(1, len(rows) + 1), pa.int32()), pa.array([np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in rows], pa.binary())], ["kind", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["kind", "data"])

    made = saved(each(run, "kind int, data binary"), "substring-anchors")
    seen = repeated(made.where("kind = 0"), "data")
    counts = np.zeros(len(LEVELS) * size, np.int64)
    part = size // 16
    for r in made.where("kind > 0").repartition("kind").mapInArrow(tidy(add), "kind int, data binary").collect():
        counts[(r["kind"] - 1) * part : r["kind"] * part] = np.frombuffer(r["data"], np.int64)
    drop_saved(made)
    return seen, counts.reshape(len(LEVELS), size)


SUFFIXES = "key long, deep boolean, doc_id long, start int, wins int, words binary"


def suffix_rows(each: Each, plan, width: int) -> DataFrame:
    """Rows of neighbouring windows that may repeat; rows without words are marks that are already settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, light, bits = plan.value
        for b in batches:
            ids = b.column(0).to_numpy()
            raw, off = K.string_parts(b.column(1))
            for lo, hi in K.chunks(off):
                w = K.split_words(raw, off, lo, hi)
                h = K.word_hashes(w)
                starts, at, grams = anchors(h, w, width)
                ok = contains(seen, grams[at]) if len(at) else np.zeros(0, bool)
                starts, at = starts[ok], at[ok]
                if not len(at):
                    continue
                prefix = _prefixes(h, at)
                deep = np.ones(len(at), bool)
                key = K.gram_hashes(h, width)[starts]
                for p, c in zip(prefix[::-1], light[::-1], strict=True):
                    ok = c[(p >> K.U64(64 - bits)).astype(np.int64)]
                    key[ok] = p[ok]
                    deep[ok] = False
                head = _changes(at) | deep
                head[1:] |= starts[1:] != starts[:-1] + 1
                first = np.flatnonzero(head)
                wins = np.diff(np.concatenate((first, [len(at)])))
                begin, key, deep, length = starts[first], key[first], deep[first], wins + width - 1
                words = h[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())]
                doc = w.doc[begin]
                own, place = ids[lo:hi][doc], begin - w.first[doc]
                # equal rows of this batch: the earliest goes on, the others are repeats as a whole
                edge = np.cumsum(length) - length
                with np.errstate(over="ignore"):
                    turn = np.arange(length.sum()) - np.repeat(edge, length)
                    one = np.add.reduceat(K.mix64(words + turn.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)), edge)
                    two = np.add.reduceat(K.mix64(words ^ K.mix64(turn.astype(K.U64) + K.U64(99))), edge)
                order = np.lexsort((place, own, wins, two, one))
                new = _changes(one[order], two[order], wins[order])
                lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                copy = np.zeros(len(order), bool)
                copy[order] = (own[order] != own[lead]) | (place[order] != place[lead])
                keep = ~copy
                kept = words[np.repeat(keep, length)]
                yield _rows(key[keep], deep[keep], own[keep], place[keep], wins[keep], _pack(kept, length[keep]))
                if copy.any():
                    n = int(copy.sum())
                    yield _rows(K.mix64(np.arange(n, dtype=K.U64)), deep[copy], own[copy], place[copy], wins[copy], pa.nulls(n, pa.binary()))

    return each(run, SUFFIXES)


def _rows(key, deep, own, place, wins, words) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(deep), pa.array(own), pa.array(place, pa.int32()), pa.array(wins, pa.int32()), words], ["key", "deep", "doc_id", "start", "wins", "words"])


def suffix_tree(words: np.ndarray, length: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, words that each has in common with the one before it).

    ``words`` holds rows of ``length`` words, one after the other; the suffixes
    are those that begin at the first ``starts`` places of each row.  The two
    arrays are the suffix tree: its internal nodes are the runs of suffixes whose
    common lengths exceed those at both ends.  Ranks of 1, 2, 4, ... words give
    order and common lengths; a mark that is less than any word ends each row.
    """
    row, most = np.repeat(np.arange(len(length)), length), int(length.max(initial=1))
    rank = np.zeros(len(words) + len(length) + 2 * most, np.uint64)
    rank[np.arange(len(words)) + row] = np.unique(words, return_inverse=True)[1] + 1
    ranks = [rank]
    while 2 << (len(ranks) - 1) <= most:
        shift, pair = 1 << (len(ranks) - 1), ranks[-1] << np.uint64(32)
        pair[:-shift] |= ranks[-1][shift:]
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.uint64))
    top = 1 << (len(ranks) - 1)
    inner = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    at = np.repeat(np.cumsum(length) - length + np.arange(len(length)), starts) + inner
    room = np.repeat(length, starts) - inner
    order = np.lexsort([ranks[-1][at + k] for k in range(0, most, top)][::-1])
    p, q = at[order][1:], at[order][:-1]
    left = np.minimum(room[order][1:], room[order][:-1])
    same = np.zeros(len(left), np.int64)
    for level in [len(ranks) - 1] * (most // top) + list(range(len(ranks) - 2, -1, -1)):
        go = same + (1 << level) <= left
        go[go] = ranks[level][(p + same)[go]] == ranks[level][(q + same)[go]]
        same[go] += 1 << level
    return order, np.concatenate(([0], same))[: len(order)]


def _later_leaves(rows: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the leaves that are not the earliest of their node of ``width`` words or more."""
    doc, start, wins, words = (np.concatenate(x) for x in zip(*rows, strict=True))
    order, common = suffix_tree(words, wins + width - 1, wins)
    node = np.cumsum(common < width)  # the shallowest nodes that are deep enough; others are alone
    inner = np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins)
    doc, place = np.repeat(doc, wins)[order], (np.repeat(start, wins) + inner)[order]
    by = np.lexsort((place, doc, node))
    lead = by[np.searchsorted(node[by], node[by])]
    late = (doc[by] != doc[lead]) | (place[by] != place[lead])
    return doc[by][late], place[by][late]


def counter_bits(docs: DataFrame) -> int:
    """So many counters that a prefix's count is little more than its own, within bounds."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(max((size // COUNTER_BYTES).bit_length(), COUNTER_BITS[0]), COUNTER_BITS[1])


def repeats(sc: SparkContext, each: Each, width: int = WIDTH, bits: int = COUNTER_BITS[0]) -> DataFrame:
    """(doc_id, starts): packed starts of windows that also start earlier; several rows per document."""
    seen, counts = anchor_counts(each, width, bits)
    plan = sc.broadcast((seen, counts <= GROUP, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last, firsts = 0, None, {}
        for b in batches:
            live = b.column(5).is_valid().to_numpy(zero_copy_only=False)
            if (~live).any():
                settled = b.filter(pa.array(~live))
                wins = settled.column(4).to_numpy().astype(np.int64)
                inner = np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins)
                yield _marks(np.repeat(settled.column(2).to_numpy(), wins), np.repeat(settled.column(3).to_numpy().astype(np.int64), wins) + inner)
                b = b.filter(pa.array(live))
            if not b.num_rows:
                continue
            key, deep = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cut = np.concatenate((np.flatnonzero(_changes(key, deep)), [len(key)]))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                part = b.slice(i, j - i)
                doc, start = part.column(2).to_numpy(), part.column(3).to_numpy().astype(np.int64)
                if (key[i], deep[i]) != last:
                    if size > _BATCH_WORDS:
                        yield _marks(*_later_leaves(rows, width))
                        rows, size = [], 0
                    last, firsts = (key[i], deep[i]), {}
                if deep[i]:  # one node: its leaves come in order, the first is the earliest
                    late = np.zeros(len(doc), bool)
                    for k, x in enumerate(part.column(5)):
                        here = (int(doc[k]), int(start[k]))
                        late[k] = firsts.setdefault(x.as_buffer().to_pybytes(), here) != here
                    if late.any():
                        yield _marks(doc[late], start[late])
                    continue
                words = np.frombuffer(b"".join(part.column(5).to_pylist()), "<u8")
                rows.append((doc, start, part.column(4).to_numpy().astype(np.int64), words))
                size += len(words)
        if rows:
            yield _marks(*_later_leaves(rows, width))

    rows = suffix_rows(each, plan, width).repartition("key").sortWithinPartitions("key", "deep", "doc_id", "start")
    return rows.mapInArrow(tidy(run), "doc_id long, starts binary")


def _marks(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype("<u4")
    first, size = K.group_spans(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc[first], pa.int64()), pa.array([start[i : i + n].tobytes() for i, n in zip(first, size, strict=True)], pa.binary())], ["doc_id", "starts"])


def remove(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_words, n_removed, kept (the words left, joined by spaces)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if plain_ids(docs):
        return _remove(source, width)
    rows = keyed(source, "substring-rows").select("key", "row.*")
    own = F.when(F.col("doc_id").isNull(), F.col("key"))
    named = saved(rows.select("key", "doc_id", F.md5("text").alias("digest"), own.alias("own"), F.lit(1).alias("one")), "substring-named", True)
    order = [F.col("doc_id").asc_nulls_last(), F.col("digest").asc(), F.col("own").asc()]
    ranked = ranged_prefix(named.drop("key").distinct(), order, {"rank": "one"}, None, "substring")
    ranked = saved(ranked.select(F.col("doc_id").alias("i"), F.col("digest").alias("d"), F.col("own").alias("o"), "rank"), "substring-ranks", True)
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")) & F.col("own").eqNullSafe(F.col("o"))
    named = saved(named.join(ranked, same).select("key", "doc_id", "rank"), "substring-named", True)
    texts = rows.join(named.groupBy("rank").agg(F.min("key").alias("key")), "key").select(F.col("rank").alias("doc_id"), "text")
    left = _remove(saved(texts, "substring-texts"), width).withColumnRenamed("doc_id", "rank")
    return named.join(left, "rank").select("doc_id", "n_words", "n_removed", "kept")


def _remove(docs: DataFrame, width: int) -> DataFrame:
    """``remove`` where every row has an id of its own."""
    sc = docs.sparkSession.sparkContext
    bits = counter_bits(docs)
    digests = saved(docs.select("doc_id", F.unhex(F.md5("text")).alias("digest")), "substring-digests", True)
    firsts = saved(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "substring-firsts", True)
    copies = saved(digests.join(firsts, "digest").where("doc_id > first").select(F.col("doc_id").alias("copy")).distinct(), "substring-copies", True)
    drop_saved(digests)
    marked = sc.broadcast(members(copies, "copy"))
    unsure = only(docs, marked).join(copies, F.col("doc_id") == F.col("copy"), "left_anti")
    marks = saved(repeats(sc, lambda f, kind: docs.mapInArrow(tidy(unless(marked, f)), kind).union(unsure.mapInArrow(tidy(f), kind)), width, bits), "substring-marks")
    touched = sc.broadcast(members(copies.select("copy").union(marks.select("doc_id")), "copy"))
    maybe = only(docs, touched)
    mine = marks.groupBy(F.col("doc_id").alias("_marked")).agg(F.collect_list("starts").alias("starts"))
    maybe = maybe.join(copies, F.col("doc_id") == F.col("copy"), "left").join(mine, F.col("doc_id") == F.col("_marked"), "left")
    schema = "doc_id long, n_words long, n_removed long, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                yield _left_over(whole.slice(lo, _ROWS), width)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(tidy(unless(touched, run)), schema).union(maybe.select("doc_id", "text", "copy", "starts").mapInArrow(tidy(run), schema))


def _left_over(b: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """What is left of the texts of (doc_id, text) or (doc_id, text, copy, starts)."""
    lists = b.column(3) if b.num_columns > 3 else None
    copy = b.column(2).is_valid().to_pylist() if b.num_columns > 2 else [False] * b.num_rows
    n_words, n_removed, kept = [], [], []
    for k in range(b.num_rows):
        words = b.column(1)[k].as_buffer().to_pybytes().split()
        gone, left = 0, words
        if copy[k] and len(words) >= width:
            gone, left = len(words), []
        elif lists is not None and lists[k].is_valid:
            starts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in lists[k].values]).astype(np.int64)
            turn = np.zeros(len(words) + 1, np.int64)
            np.add.at(turn, starts, 1)
            np.add.at(turn, starts + width, -1)
            under = np.cumsum(turn)[:-1] > 0
            gone, left = int(under.sum()), [x for x, u in zip(words, under, strict=True) if not u]
        n_words.append(len(words))
        n_removed.append(gone)
        kept.append(b" ".join(left).decode())
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _chosen(batches: Iterator[pa.RecordBatch], ids, wanted: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, _ROWS):
            b = whole.slice(lo, _ROWS)
            hit = contains(ids.value, id_hash(b.column(0).to_numpy())) == wanted
            if hit.any():
                yield b if hit.all() else b.filter(pa.array(hit))
        pa.default_memory_pool().release_unused()


def only(docs: DataFrame, ids) -> DataFrame:
    """Rows whose id is in the bitmap, and a few others."""
    return docs.mapInArrow(tidy(lambda batches: _chosen(batches, ids, True)), docs.schema)


def unless(ids, f: Callable) -> Callable:
    """``f`` over the rows that ``only`` leaves out, in the same worker."""
    return lambda batches: f(_chosen(batches, ids, False))
