"""N-gram Jaccard self-join as a blocked sparse matrix product.

A document is its set of distinct shingles of ``n`` words (3 unless told); sets
link from a Jaccard similarity of ``percent`` (90 unless told).  Documents with the same set
are one class.  For a class of size n only the n - ceil(t n) + 1 shingles that
are rarest in the corpus can be the first that it shares with a partner, so
only these enter the product; sizes and positions bound what a pair can still
share.  Rarity is read from counts in 2**18 hash buckets, over all documents.

The product loses no link between components.  Columns of few documents are
multiplied at once.  Large ones go through steps:

1. hubs: in every shingle's column, all documents are paired with a few of
   them, and again with others where components still differ, which settles
   groups of near copies without pairing them all;
2. blocks: columns whose documents still belong to several components are cut
   into blocks by size, and what is outside a column's main component is
   multiplied with the blocks that its size allows, skipping pairs within one
   component.  Overlap bounds come from bucketed shingle counts.

Pairs that pass the bounds are verified on whole sets, exactly.

Defined results: null and empty texts have no shingles and link with nothing;
texts of fewer than ``n`` words have one shingle, the whole sequence; texts of
any length are compared as whole sets; repeated rows are one class; shingles that
tie in rarity are ordered by hash, which no result depends on; a null id joins
its class and is nobody's representative; where ids are null or repeat, rows are
joined by a key of their own, so that every text has its links, and components
are named by their smallest id; an empty table gives no rows; ``join`` ignores
other columns, and ``keep_one`` returns them as they are, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import WORD, drop_saved, keep_matching, keyed, plain_ids, saved, tidy
from .filters import contains, id_hash, members, repeated
from .graph import components

#: Default similarity in percent and words of a shingle; hash buckets for rarity; bins of a sketch.
PERCENT, WORDS, RARITY_BITS, BINS = 90, 3, 18, 128
#: Documents of a column that is paired at once; hubs of a larger one in each step; steps; documents of a block.
FEW, HUBS, STEPS, BLOCK = 32, 3, 2, 256
#: A bin's count that may be larger; documents with one pass every bound.  Pairs whose sketches are compared together.
_FULL, _PAIRS = 255, 8192
_SLICE = 1 << 12


def chunk_sets(w: K.Words, n: int, rarity: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, document of each, rarity of each), distinct by document, rarest first."""
    h = K.word_hashes(w, K.LOWER)
    at = K.windows_inside(w, n)
    s, doc = K.gram_hashes(h, n)[at], w.doc[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(few):
        short = np.zeros(len(few), K.U64)
        with np.errstate(over="ignore"):
            for k in range(n - 1):
                has = w.counts[few] > k
                short[has] = K.mix64(short[has] * K.U64(31) + h[w.first[few[has]] + k])
        s, doc = np.concatenate((s, short)), np.concatenate((doc, few))
    count = (rarity[(s >> K.U64(64 - RARITY_BITS)).astype(np.int64)] if rarity is not None else np.zeros(len(s), np.int64)).astype(np.int64)
    order = np.lexsort((s, count, doc))
    s, doc, count = s[order], doc[order], count[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[keep], doc[keep], count[keep]


def rarity_counts(docs: DataFrame, n: int = WORDS) -> np.ndarray:
    """Shingle occurrences by hash bucket over all documents; 2 MB whatever the corpus."""
    size = 1 << RARITY_BITS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            raw, off = K.string_parts(b.column(0))
            for lo, hi in K.chunks(off):
                w = K.split_words(raw, off, lo, hi)
                s = K.gram_hashes(K.word_hashes(w, K.LOWER), n)[K.windows_inside(w, n)]
                total += np.bincount((s >> K.U64(64 - RARITY_BITS)).astype(np.int64), minlength=size)
        parts = range(0, size, _SLICE)
        yield pa.RecordBatch.from_arrays([pa.array([p // _SLICE for p in parts], pa.int32()), pa.array([np.minimum(total[p : p + _SLICE], (1 << 32) - 1).astype("<u4").tobytes() for p in parts], pa.binary())], ["slice", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "data"])

    out = np.zeros(size, np.int64)
    for r in docs.select(F.col("text").cast("string")).mapInArrow(tidy(send), "slice int, data binary").repartition("slice").mapInArrow(tidy(add), "slice int, data binary").collect():
        out[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(r["data"], np.int64)
    return out


def signatures(docs: DataFrame, rarity, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, fingerprint of the set (f, g), prefix (packed shingles, rarest first), sketch (counts by bin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rarity.value
        for b in batches:
            raw, off = K.string_parts(b.column(1))
            for lo, hi in K.chunks(off):
                w = K.split_words(raw, off, lo, hi)
                s, doc, _ = chunk_sets(w, n, counts)
                size = np.bincount(doc, minlength=hi - lo)
                first = np.concatenate(([0], np.cumsum(size)))
                f, g = np.zeros(hi - lo, K.U64), np.zeros(hi - lo, K.U64)
                some = size > 0
                if some.any():
                    f[some] = np.add.reduceat(K.mix64(s), first[:-1][some])
                    g[some] = np.add.reduceat(K.mix64(s ^ K.U64(0x5851F42D4C957F2D)), first[:-1][some])
                lead = np.where(some, size - -(-percent * size // 100) + 1, 0)
                packed = s.astype("<u8")
                prefix = [packed[i : i + k].tobytes() for i, k in zip(first[:-1], lead, strict=True)]
                bins = np.bincount(doc * BINS + (K.mix64(s) >> K.U64(57)).astype(np.int64), minlength=(hi - lo) * BINS)
                bins = np.minimum(bins, _FULL).astype(np.uint8).reshape(hi - lo, BINS)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size, pa.int32()), pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), pa.array(prefix, pa.binary()), pa.array([x.tobytes() for x in bins], pa.binary())], ["doc_id", "n", "f", "g", "prefix", "sketch"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "doc_id long, n int, f long, g long, prefix binary, sketch binary")


def postings(reps: DataFrame, shared) -> DataFrame:
    """(token, rep, n, pos) of prefix shingles that may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
            parts = [np.frombuffer(x.as_buffer(), "<u8") for x in b.column(2)]
            length = np.array([len(p) for p in parts], np.int64)
            token = np.concatenate([*parts, np.zeros(0, "<u8")])
            row = np.repeat(np.arange(len(parts)), length)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
            ok = contains(shared.value, token)
            token, row, pos = token[ok], row[ok], pos[ok]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(ids[row]), pa.array(sizes[row], pa.int32()), pa.array(pos, pa.int32())], ["token", "rep", "n", "pos"])

    return reps.select("doc_id", "n", "prefix").mapInArrow(tidy(run), "token long, rep long, n int, pos int")


def _may_link(na, nb, overlap, percent: int = PERCENT):
    """Whether sets of these sizes with this overlap (or bound) are similar enough."""
    return (100 + percent) * overlap >= percent * (na + nb)


def sets_of(docs: DataFrame, ids: DataFrame, column: str, n: int = WORDS) -> DataFrame:
    """(id, shingles): whole sets, sorted, of at least the documents in ``ids``; no shuffle of texts."""
    wanted = docs.sparkSession.sparkContext.broadcast(members(ids, column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(contains(wanted.value, id_hash(b.column(0).to_numpy(zero_copy_only=False)))))
            if not b.num_rows:
                continue
            raw, off = K.string_parts(b.column(1))
            for lo, hi in K.chunks(off):
                s, doc, _ = chunk_sets(K.split_words(raw, off, lo, hi), n, None)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                s = s.astype("<u8")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([s[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["id", "shingles"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return source.mapInArrow(tidy(run), "id long, shingles binary")


def verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of ``pairs`` that link, by overlap bounds first and then by whole sets."""
    sa, sb = (sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (4, 5))
            full = (x == _FULL).any(1) | (y == _FULL).any(1)
            ok = full | _may_link(na, nb, np.minimum(x, y).sum(1, dtype=np.int64), percent)
            yield b.filter(pa.array(ok)).select(["a", "b"])

    near = saved(pairs.join(sa, "a").join(sb, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(bound), "a long, b long"), "ngram-near", True)
    whole = saved(sets_of(docs, near.select(F.col("a").alias("id")).union(near.select("b")), "id", n), "ngram-sets", True)

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate((x, y)))
                ok.append(bool(_may_link(len(x), len(y), int((both[1:] == both[:-1]).sum()), percent)))
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    wa, wb = (whole.select(F.col("id").alias(x), F.col("shingles").alias(f"w{x}")) for x in "ab")
    links = saved(near.join(wa, "a").join(wb, "b").select("a", "b", "wa", "wb").mapInArrow(tidy(overlap), "a long, b long"), "ngram-links", True)
    drop_saved(near, whole)
    return links


def _sizes_fit(na: F.Column, nb: F.Column, percent: int) -> F.Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _fits(na: F.Column, pa_: F.Column, nb: F.Column, pb: F.Column, percent: int) -> F.Column:
    """Whether sizes, and positions in the prefixes, allow a link."""
    return _sizes_fit(na, nb, percent) & _may_link(na, nb, F.least(na - pa_, nb - pb), percent)


def named(post: DataFrame, found: DataFrame | None) -> DataFrame:
    """Postings with the component that each document is in so far."""
    if found is None:
        return post.withColumn("comp", F.col("rep"))
    return post.join(found.withColumnRenamed("component", "_comp"), F.col("rep") == F.col("node"), "left").select("token", "rep", "n", "pos", F.coalesce("_comp", "rep").alias("comp"))


def hub_pairs(post: DataFrame, found: DataFrame | None, step: int, percent: int = PERCENT) -> DataFrame:
    """Each document of a large column paired with the column's hubs of this step, where bounds allow and components differ."""
    post = named(post, found)
    draw = [F.min(F.struct(F.xxhash64("rep", F.lit(HUBS * step + k)).alias("h"), "rep", "n", "pos", "comp")).alias(f"hub{k}") for k in range(HUBS)]
    hubs = post.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *draw).where("lo <> hi")
    hubs = saved(hubs.select(F.col("token").alias("t"), F.array_distinct(F.array(*[f"hub{k}" for k in range(HUBS)])).alias("hubs")), "ngram-hubs", True)
    met = post.join(hubs, F.col("token") == F.col("t")).select("rep", "n", "pos", "comp", F.explode("hubs").alias("hub"))
    ok = (F.col("comp") != F.col("hub.comp")) & _fits(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent)
    return met.where(ok).select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()


def small_pairs(post: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs of columns of at most ``FEW`` documents that the bounds allow."""
    x = post.select("token", *(F.col(c).alias(f"{c}1") for c in ("rep", "n", "pos")))
    y = post.select("token", *(F.col(c).alias(f"{c}2") for c in ("rep", "n", "pos")))
    met = x.join(y, "token").where((F.col("rep1") < F.col("rep2")) & _fits(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2"), percent))
    return met.select(F.col("rep1").alias("a"), F.col("rep2").alias("b")).distinct()


def block_pairs(post: DataFrame, found: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of different components that a large column still allows, from products of its blocks.

    Documents of a column's main component meet only those of its others.  A
    column is cut into bands of sizes, and a band into blocks; a document of
    another component goes to the blocks of the bands that its size can link
    with, and every block is held by itself while those stream past it.
    """
    all_ = saved(named(post, found), "ngram-named", True)
    mixed = all_.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed = saved(mixed.select(F.col("token").alias("t"), F.col("main.comp").alias("main")), "ngram-mixed", True)
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n")
    open_ = saved(all_.join(mixed, F.col("token") == F.col("t")).select("token", "rep", "n", "pos", "comp", "main", band.alias("band")), "ngram-open", True)
    sizes = open_.groupBy("token", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = saved(sizes.select(F.col("token").alias("t"), F.col("band").alias("z"), "blocks"), "ngram-bands", True)
    here = (F.col("token") == F.col("t")) & (F.col("zone") == F.col("z"))
    cell = ["token", "zone", "block", "side", "rep", "comp", "n", "pos"]
    held = open_.withColumn("zone", F.col("band")).join(sizes, here).withColumns({"block": F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), "side": F.lit(0)}).select(*cell)
    past = open_.where("comp <> main").withColumn("zone", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))).join(sizes, here)
    past = past.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1)).select(*cell)
    rows = held.union(past).join(sketches.select(F.col("doc_id").alias("rep"), "sketch"), "rep").select(*cell, "sketch")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for b in batches:
            key = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(4)])
            rep, comp, n, pos = (b.column(k).to_numpy().astype(np.int64) for k in range(4, 8))
            sketch = np.frombuffer(b"".join(b.column(8).to_pylist()), np.uint8).reshape(-1, BINS)
            cut = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [b.num_rows]))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                part = tuple(x[i:j] for x in (rep, comp, n, pos, sketch))
                name = tuple(key[:3, i])
                if key[3, i] == 0:
                    block = part if name != at else tuple(np.concatenate(x) for x in zip(block, part, strict=True))
                    at = name
                elif name == at:
                    for k in range(i, j, BLOCK):
                        yield from _meet(tuple(x[k : min(k + BLOCK, j)] for x in (rep, comp, n, pos, sketch)), block, percent)

    dealt = rows.repartition("token", "zone", "block").sortWithinPartitions("token", "zone", "block", "side")
    out = saved(dealt.mapInArrow(tidy(product), "a long, b long").distinct(), "ngram-pairs", True)
    drop_saved(all_, mixed, open_, sizes)
    return out


def _meet(x: tuple, y: tuple, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks (rep, comp, n, pos, sketch) that every bound allows."""
    n, m = x[2][:, None], y[2][None, :]
    ok = (x[1][:, None] != y[1][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    ok &= _may_link(n, m, np.minimum(n - x[3][:, None], m - y[3][None, :]), percent)
    i, j = np.nonzero(ok)
    for k in range(0, len(i), _PAIRS):
        p, q = i[k : k + _PAIRS], j[k : k + _PAIRS]
        s, t = x[4][p], y[4][q]
        fit = (s == _FULL).any(1) | (t == _FULL).any(1) | _may_link(x[2][p], y[2][q], np.minimum(s, t).sum(1, dtype=np.int64), percent)
        p, q = x[0][p[fit]], y[0][q[fit]]
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, id, text, row) of rows under a number of their own."""
    return keyed(docs, "ngram-rows").select("key", F.col("row.doc_id").cast("long").alias("id"), F.col("row.text").cast("string").alias("text"), "row")


def join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_shingles, class_id, component_id.

    Components of rows whose id repeats with other texts may share a name.
    """
    if plain_ids(docs):
        return join_keys(docs, n, percent)
    rows = _keyed(docs.select("doc_id", "text"))
    found = join_keys(rows.select(F.col("key").alias("doc_id"), "text"), n, percent).withColumnRenamed("doc_id", "key")
    found = saved(found.join(rows.select("key", "id"), "key"), "ngram-named", True)
    classes, comps = (found.groupBy(c).agg(F.min("id").alias(f"{c}_name")) for c in ("class_id", "component_id"))
    out = found.join(classes, "class_id").join(comps, "component_id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("class_id_name").alias("class_id"), F.col("component_id_name").alias("component_id"))


def join_keys(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``join`` where every row has an id of its own."""
    sc = docs.sparkSession.sparkContext
    signs = saved(signatures(docs, sc.broadcast(rarity_counts(docs, n)), n, percent), "ngram-signatures")
    # written before the join, so that adaptive execution can split a class that holds most documents
    groups = saved(signs.where("n > 0").groupBy("f", "g", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "ngram-groups", True)
    classes = saved(signs.select("doc_id", "n", "f", "g").join(groups, ["f", "g", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "ngram-classes", True)
    copies = classes.where("doc_id <> rep").select("doc_id")
    reps = saved(signs.where("n > 0").join(copies, "doc_id", "left_anti").select("doc_id", "n", "prefix", "sketch"), "ngram-reps", True)
    drop_saved(signs, groups)
    post = saved(postings(reps, sc.broadcast(repeated(reps, "prefix"))), "ngram-postings", True)
    sketches = saved(reps.select("doc_id", "n", "sketch"), "ngram-sketches", True)
    drop_saved(reps)
    sized = saved(post.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select(F.col("token").alias("t"), "members"), "ngram-columns", True)
    column = post.join(sized, F.col("token") == F.col("t"))
    big = saved(column.where(F.col("members") > FEW).select("token", "rep", "n", "pos"), "ngram-big", True)
    links, found = [], None
    for step in range(STEPS if big.head(1) else 0):
        tried = saved(hub_pairs(big, found, step, percent), "ngram-tried", True)
        links.append(verified(tried, sketches, docs, n, percent))
        found = components(functools.reduce(DataFrame.union, links))
        drop_saved(tried)
    more = saved(small_pairs(column.where(F.col("members") <= FEW), percent), "ngram-small", True)
    if found is not None:
        x, y = (found.toDF(c, f"c{c}") for c in "ab")
        apart = more.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        more = saved(apart.union(block_pairs(big, found, sketches, percent)).distinct(), "ngram-more", True)
    links.append(verified(more, sketches, docs, n, percent))
    drop_saved(post, sized, big, more, sketches)
    found = components(functools.reduce(DataFrame.union, links))
    out = classes.join(found, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that come first in their component, by id.

    Rows without an id come last, so they stay only where no row with an id is
    linked to them, one for each component.  Rows that share an id but have
    other texts are judged each.  Rows without a shingle stay, a repeated id
    and text once.
    """
    if plain_ids(docs):
        found = saved(join_keys(docs, n, percent).select("doc_id", "component_id"), "ngram-found", True)
        return keep_matching(docs, found.where("doc_id = component_id").select("doc_id"), "left_semi")
    rows = _keyed(docs)
    found = join_keys(rows.select(F.col("key").alias("doc_id"), "text"), n, percent).select(F.col("doc_id").alias("key"), "n_shingles", "component_id")
    blank = F.when(~F.col("text").rlike(WORD), F.col("text")).alias("blank")
    found = found.join(rows.select("key", "id", blank), "key")
    bare = F.col("n_shingles") == 0
    group = [F.when(~bare, F.col("component_id")), F.when(bare, F.col("id")), F.when(bare, F.col("blank")), F.when(bare & F.col("id").isNull(), F.col("key"))]
    first = found.groupBy(*(g.alias(f"g{k}") for k, g in enumerate(group))).agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first"))
    first = saved(first.select(F.col("first.key").alias("key")), "ngram-first", True)
    return rows.join(first, "key", "left_semi").select("row.*")
