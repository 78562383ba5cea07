"""Operators against brute force on whole small tables, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm import graph, lm, mixing, ngram_join, queries, sharding, substring
from tributary.llm.graph import components

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql_gives_the_same_rows(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, data).toPandas(), c.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda df: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert text(got) == text(want)


# ---- substring deduplication ----


def without_repeats(docs):
    seen, out = set(), []
    for i, text in docs:
        w, gone = re.findall(WORD, text or ""), set()
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone.update(range(p, p + 20))
            seen.add(k)
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring(spark, data, documents):
    assert rows(queries.op4_substring(spark, data), "doc_id", "n_words", "n_removed", "kept_sha256") == without_repeats([d[:2] for d in documents])


@pytest.mark.parametrize("group", [0, 3, 40])
def test_substring_longer_prefixes(spark, data, documents, monkeypatch, group):
    """Groups too large for a short prefix go by a longer one, at last by the whole window."""
    monkeypatch.setattr(substring, "GROUP", group)
    assert rows(queries.op4_substring(spark, data), "doc_id", "n_words", "n_removed", "kept_sha256") == without_repeats([d[:2] for d in documents])


def test_substring_odd(odd, nothing):
    got = {r["doc_id"]: r for r in substring.remove(odd).collect()}
    assert substring.remove(odd).count() == odd.count() and substring.remove(nothing).count() == 0
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 40 and got[2]["kept"] == "two"
    assert got[3]["n_words"] == 0 and got[5]["kept"] == ""
    assert got[6]["n_removed"] == 0 and got[7]["n_removed"] == got[7]["n_words"] == 30_000
    assert got[None]["n_removed"] == 41  # a row without an id comes last
    assert got[12]["n_removed"] == 200 - 1  # the first window's first word alone is not under a later window


def test_substring_rows_without_or_with_repeated_ids(spark):
    """Rows without an id are documents of their own; so are other texts of one id, by their digests; equal rows are one."""
    shared = " ".join(f"s{i}" for i in range(30))
    docs = [(None, shared + " a no id"), (None, shared + " b no id"), (None, "x " + shared), (3, shared + " one"), (3, "two " + shared), (3, shared + " one"), (1, "first"), (None, None), (2, "")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    one, two = shared + " one", "two " + shared
    first = min(one, two, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    cut = {one: 30 * (first != one), two: 30 * (first != two)}
    want = [(None, 33, 30), (None, 33, 30), (None, 31, 30), (3, 31, cut[one]), (3, 31, cut[two]), (3, 31, cut[one]), (1, 1, 0), (None, 0, 0), (2, 0, 0)]
    assert got == sorted(want, key=repr)


def test_suffix_tree():
    """Order and common lengths of suffixes against comparing them word by word."""
    rng = np.random.default_rng(1)
    for most in (1, 5, 20, 33):
        length = rng.integers(1, most + 1, 60)
        starts = np.array([rng.integers(1, n + 1) for n in length])
        words = rng.integers(0, 2, length.sum()).astype(np.uint64)
        order, common = substring.suffix_tree(words, length, starts)
        text = [tuple(x[k:].tolist()) for x, s in zip(np.split(words, np.cumsum(length)[:-1]), starts, strict=True) for k in range(s)]
        assert [text[k] for k in order] == sorted(text) and common[0] == 0
        for k in range(1, len(text)):
            a, b = text[order[k - 1]], text[order[k]]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


# ---- n-gram join ----


def linked(docs):
    sets, up = {}, {}
    for i, text in docs:
        w = re.findall(WORD, (text or "").translate(LOWER))
        sets[i] = frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 10 * min(len(sets[a]), len(sets[b])) >= 9 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return sorted(((i, len(sets[i]), find(i)) for i in sets), key=repr)


def test_ngram_join(spark, data, documents):
    assert rows(queries.op7_ngram_join(spark, data), "doc_id", "n_shingles", "component_id") == linked([d[:2] for d in documents])


@pytest.mark.parametrize("few", [0, 8, 64])
def test_ngram_join_near_copies(spark, monkeypatch, few):
    """A large group of near copies, many of them linked only through others; small blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(70):
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 4), replace=False):
            w[j] = f"v{rng.integers(0, 9)}"
        docs.append((i, " ".join(w)))
    docs += [(100, "a b"), (101, "A  B"), (102, "a"), (103, None), (104, ""), (105, "")]
    got = rows(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == linked(docs)


def test_ngram_odd(odd, nothing):
    got = {r["doc_id"]: r for r in ngram_join.join(odd).collect()}
    assert ngram_join.join(odd).count() == odd.count() and ngram_join.join(nothing).count() == 0
    assert got[2]["component_id"] == 1 and got[None]["component_id"] == 1 and got[7]["component_id"] == 6
    assert got[4]["component_id"] == 4 and got[3]["n_shingles"] == 0 and got[8]["n_shingles"] == 1
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13]


def first_of_each(docs, n, percent):
    """The first id of each component, by brute force over every pair of sets of n-word shingles."""
    sets, up = {}, {}
    for i, text in docs:
        w = re.findall(WORD, (text or "").translate(LOWER))
        sets[i] = frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return sorted({find(i) for i in sets})


def test_near_duplicates_stage(spark):
    """Near copies of five-word similarity 0.8, most of them under 0.9 by three words."""
    rng = np.random.default_rng(4)
    docs = []
    for g in range(40):
        w = [f"w{g}x{i}" for i in range(100)]
        for i in range(4):
            v = list(w)
            for j in rng.choice(100, rng.integers(0, 5), replace=False):
                v[j] = f"v{g}x{i}x{j}"
            docs.append((10 * g + i, " ".join(v)))
    docs += [(900, "a b c d"), (901, "A b  c d"), (902, "a b c"), (903, None), (904, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = first_of_each(docs, 5, 80)
    assert want != first_of_each(docs, 3, 90)
    assert [i for (i,) in rows(corpus_pipeline.near_duplicates(spark, table, ""), "doc_id")] == sorted(want, key=lambda i: repr((i,)))


def test_near_duplicates_stage_on_documents(spark, data, documents):
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
    assert sorted(r["doc_id"] for r in got.collect()) == first_of_each([d[:2] for d in documents], 5, 80)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Clean documents stay whatever their id; links of every text of an id count."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    clean = [(None, " ".join(f"n{k}x{i}" for i in range(20)), f"clean{k}") for k in range(50)]
    docs = clean + [
        (1, one, "a"), (1, two, "b"), (1, one, "a again"), (2, two, "copy of b"), (None, one, "copy of a"), (None, three, "c"), (None, three, "copy of c"), (3, None, "null"), (3, None, "null again"),
        (3, "", "empty"), (None, None, "no id 1"), (None, None, "no id 2"), (None, "", "no id 3"), (9, "few words", "short"),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string, key string")
    kept = [r["key"].split(" again")[0].replace("copy of c", "c") for r in ngram_join.keep_one(table).collect()]
    assert sorted(kept) == sorted([f"clean{k}" for k in range(50)] + ["a", "b", "c", "null", "empty", "no id 1", "no id 2", "no id 3", "short"])
    got = ngram_join.join(table).collect()
    assert len(got) == len(docs) and {r["component_id"] for r in got if r["doc_id"] == 2} == {1}
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] == 1) == [28] * 3


@pytest.mark.parametrize("part", [200_000, 7])
def test_components(spark, monkeypatch, part):
    """One task's links at once, or links of many tasks in rounds."""
    monkeypatch.setattr(graph, "PART", part)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "a long, b long").repartition(6)).collect())
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and len(got) == 43
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_rounds(spark, monkeypatch):
    tags = []
    monkeypatch.setattr(graph, "PART", 5)
    monkeypatch.setattr(graph, "saved", lambda df, tag, few=False, f=graph.saved: (tags.append(tag), f(df, tag, few))[1])
    links = [(i, i + 1) for i in range(199)] + [(1000, 1001 + i) for i in range(50)] + [(2050, 2000 + i) for i in range(50)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long").repartition(40)).collect())
    assert got == {**dict.fromkeys(range(200), 0), **dict.fromkeys(range(1000, 1051), 1000), **dict.fromkeys(range(2000, 2051), 2000)}
    assert 0 < tags.count("cc-hook") <= 25


# ---- language model ----


def test_lattice_is_a_sum_over_segmentations():
    names, w = lm.pieces(lm.VOCABULARY)
    slots, longest = lm.lattice(lm.VOCABULARY)
    logp = dict(zip(names, w, strict=True))

    def every(s):  # all segmentations, one by one
        if not s:
            yield 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in logp:
                for rest in every(s[n:]):
                    yield logp[s[:n]] + rest

    for word in (b"the", b"banana", "é1ñ".encode()):
        block = np.frombuffer(lm._SPACE + word, np.uint8)[None, :]
        got, uses = lm.forward(block, w, slots, longest, np.ones(1))
        paths = np.array(list(every(lm._SPACE + word)))
        assert got[0] == pytest.approx(np.logaddexp.reduce(paths))
        assert (uses * [len(n) for n in names]).sum() == pytest.approx(len(word) + 3)  # every byte is in one piece


def test_long_words_go_another_way(monkeypatch):
    names, w = lm.pieces(lm.VOCABULARY)
    slots, longest = lm.lattice(lm.VOCABULARY)
    rng = np.random.default_rng(2)
    block = np.concatenate([np.tile(np.frombuffer(lm._SPACE, np.uint8), (3, 1)), rng.integers(97, 123, (3, 60)).astype(np.uint8)], 1)
    monkeypatch.setattr(lm, "_FEW", 0)
    want, uses = lm.forward(block, w, slots, longest, np.array([1.0, 2.0, 3.0]))
    monkeypatch.setattr(lm, "_LONG", 10)
    monkeypatch.setattr(lm, "_STRETCH", 7)
    got, more = lm.forward(block, w, slots, longest, np.array([1.0, 2.0, 3.0]))
    assert got == pytest.approx(want) and more == pytest.approx(uses)
    assert lm.forward(block, w, slots, longest)[0] == pytest.approx(want)


class PlainLattice:
    """Unigram model over the vocabulary's pieces, word by word in plain Python."""

    def __init__(self, train, rounds=lm.ROUNDS):
        names, w = lm.pieces(lm.VOCABULARY)
        self.p = {n: math.exp(x) for n, x in zip(names, w, strict=True)}
        self.end = 1 / (len(names) + 1)
        self.longest = max(map(len, names))
        count, ends = Counter(x for words in train for x in words if x is not None), len(train)
        for _ in range(rounds if ends else 0):
            uses = dict.fromkeys(self.p, lm.FLOOR)
            for word, n in count.items():
                s, into, out = self.tables(word)
                for i in range(len(s)):
                    for j in range(i + 1, min(len(s), i + self.longest) + 1):
                        if s[i:j] in self.p:
                            uses[s[i:j]] += n * into[i] * self.p[s[i:j]] * out[j] / into[-1]
            total = sum(uses.values()) + ends
            self.p, self.end = {k: x / total for k, x in uses.items()}, ends / total

    def tables(self, word):
        s = "\u2581".encode() + word.encode()
        into, out = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
        for j in range(1, len(s) + 1):
            into[j] = sum(into[i] * self.p.get(s[i:j], 0.0) for i in range(max(0, j - self.longest), j))
        for i in reversed(range(len(s))):
            out[i] = sum(self.p.get(s[i:j], 0.0) * out[j] for j in range(i + 1, min(len(s), i + self.longest) + 1))
        return s, into, out

    def score(self, words):
        return sum(math.log10(self.end if x is None else self.tables(x)[1][-1]) for x in words)


def in_training(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


def checked_lm(got, docs, learn, plain):
    """Rows of (doc_id, text) and what they scored, in one order; ``learn``: whether an id is training."""
    texts = [re.findall(WORD, (t or "").translate(LOWER)) + [None] for _, t in docs]
    train = [x for (i, _), x in zip(docs, texts, strict=True) if learn(i)]
    count = Counter(w for x in train for w in x)
    n, v = sum(count.values()), len(count)
    want = sorted(((len(x), sum(count[w] > 0 for w in x), n, i, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), plain.score(x)) for (i, _), x in zip(docs, texts, strict=True)), key=lambda r: (r[3] is None, r[3] or 0, r[0], r[5]))
    got = sorted(((r["n_tokens"], r["n_known"], r["train_tokens"], r["doc_id"], r["base_score"], r["score"]) for r in got), key=lambda r: (r[3] is None, r[3] or 0, r[0], r[5]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want]) and [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-6)


def test_lm(spark, data, documents, monkeypatch):
    """Every score of the whole table against sums over segmentations made here, training included."""
    docs = [d[:2] for d in documents]
    plain = PlainLattice([re.findall(WORD, (t or "").translate(LOWER)) + [None] for i, t in docs if in_training(i)])
    for common in (1 << 19, 50):
        monkeypatch.setattr(lm, "COMMON", common)
        got = queries.op2_lm(spark, data).collect()
        assert all(r["held_out"] != in_training(r["doc_id"]) for r in got)
        checked_lm(got, docs, in_training, plain)


def test_lm_is_a_distribution_over_pieces():
    """Learnt weights and the end symbol sum to one."""
    plain = PlainLattice([["banana", "band", None], ["ban", None]])
    assert sum(plain.p.values()) + plain.end == pytest.approx(1)


def test_lm_odd(spark, odd, nothing, monkeypatch):
    """Null and repeated ids are scored row by row; nulls, blanks, very long words and texts included."""
    monkeypatch.setattr(lm, "_MERGE", 10)
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    docs += [(None, "another text without an id"), (1, "another text of a repeated id"), (20, "y" * 100 + " end")]
    table = odd.select("doc_id", "text", "score", "held_out").unionByName(spark.createDataFrame(docs[-3:], "doc_id long, text string"), allowMissingColumns=True)
    small = [(i, t) for i, t in docs if len(t or "") < 15_000]
    plain = PlainLattice([re.findall(WORD, (t or "").translate(LOWER)) + [None] for _, t in small], 1)
    kept = table.where("text is null or length(text) < 15000")
    checked_lm(lm.score(kept, F.lit(True), rounds=1).collect(), small, lambda i: True, plain)
    got = lm.score(table, F.lit(True)).collect()
    assert len(got) == len(docs) and all(math.isfinite(r["score"]) for r in got)
    assert lm.score(nothing, F.lit(True)).count() == 0
    untrained = lm.score(odd.where("doc_id = 8"), F.lit(False)).first()
    assert untrained["n_known"] == 0 and untrained["score"] == pytest.approx(PlainLattice([]).score(["short", None]))


# ---- mixing ----


def mixed(sized, weights=(1, 2, 3)):
    """Targets by sharing again and again, cuts by walking each source in the order of its keys."""
    total, size = sum(n for *_, n in sized), Counter()
    for _, s, n in sized:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(total)
    while left > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / w
        left = 0.0
        for s in list(open_):
            if target[s] >= 3 * size[s]:
                left += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
                open_.discard(s)
    return size, target


def test_mixing(spark, data, documents):
    sized = [(i, s, len(re.findall(WORD, t))) for i, t, _, s in documents]
    size, target = mixed(sized)
    got = queries.op10_mixing(spark, data).join(spark.createDataFrame([(d[0], d[3]) for d in documents], "doc_id long, source string"), "doc_id").collect()
    assert len(got) == len(documents)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    again = queries.op10_mixing(spark, data)
    assert rows(again, "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in got), key=repr)


def test_mixing_odd(odd, nothing):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and mixing.mix(nothing).count() == 0
    size, target = mixed([(r["doc_id"], r["source"], r["size"]) for r in got])
    assert target[None] == 3 * size[None]  # tiny sources stop at three times their size
    for s in size:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= 1
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed_documents(odd.where("text is null or text = ''")).count() == 2


def test_mixed_documents_of_repeated_and_null_ids(spark):
    """Rows that share an id, or have none, are cut each; no source exceeds its target by more than a document."""
    docs = [(None if i % 3 == 0 else 1 + i % 5, "abcabcdd"[i % 8], " ".join(["w"] * (1 + i % 40)), i) for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, source string, text string, before long")
    size, target = mixed([(i, s, len(t.split())) for i, s, t, _ in docs])
    got = mixing.mixed_documents(table).collect()
    taken, copies = Counter(), Counter()
    for r in got:
        taken[r["source"]] += len(r["text"].split())
        copies[r["before"]] += 1
    assert all(abs(taken[s] - target[s]) <= 40 for s in size) and max(copies.values()) <= 3


def test_mixing_is_native(spark, data, monkeypatch):
    """No Python in the plan of the result, nor of any table written on the way."""
    from tributary.llm import prefix

    plans = []
    for module in (mixing, prefix):
        monkeypatch.setattr(module, "saved", lambda df, *a, f=module.saved: (plans.append(df._jdf.queryExecution().toString()), f(df, *a))[1])
    plans.append(mixing.mix(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString())
    assert len(plans) == 5 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)


# ---- sharding ----


def test_sharding(spark, data, documents):
    got = queries.op8_sharding(spark, data).collect()
    assert len(got) == len(documents)
    text = {d[0]: d[1].encode() for d in documents}
    load, slots = Counter(), {}
    for r in got:
        assert r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest = max(r["size"] for r in got)
    assert all(abs(load[s] - sum(load.values()) / 40) <= biggest for s in range(40))


def test_sharding_keeps_groups_together(spark):
    docs = [(i, f"text {i // 3} " * 30) for i in range(900)] + [(1000 + i, f"single {i} " * (20 + i % 7)) for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 8)
    split = got.where("linked").groupBy("grp").agg(F.countDistinct("shard").alias("k")).where("k > 1").count()
    load = [r["s"] for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert split <= 3 and max(load) - min(load) < 2000


def brute_shards(docs, n_shards):
    """Least possible number of shards of each group of equal texts under the quota."""
    total = sum(len((t or "").encode()) + 16 for _, t in docs)
    by = Counter()
    for _, t in docs:
        by[t or ""] += len((t or "").encode()) + 16
    return {t: math.ceil(n / (total / n_shards)) for t, n in by.items()}


def test_sharding_gathers_large_groups(spark):
    """A group that holds a third of all bytes goes to few more shards than it must; small groups stay whole."""
    docs = [(i, "the one text of a large group of copies") for i in range(1000)] + [(2000 + i, f"text {i // 2} of its own that occurs twice") for i in range(400)] + [(9000 + i, f"another text {i} that occurs only once") for i in range(1600)]
    got = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 12).collect()
    need, used = brute_shards(docs, 12), {}
    text = dict(docs)
    for r in got:
        used.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert len(used[docs[0][1]]) <= need[docs[0][1]] + 2
    assert sum(len(s) > 1 for t, s in used.items() if t != docs[0][1]) <= 40


def test_sharded_rows_keep_their_columns(odd, nothing):
    got = sharding.sharded(odd, 4)
    assert got.columns == [c for c in odd.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    want = Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect())
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in got.collect()) == want
    assert sharding.sharded(nothing).count() == 0


def test_sharding_odd(spark, odd, nothing):
    got = sharding.shard(odd, 4).collect()
    assert len(got) == odd.count() and sharding.shard(nothing).count() == 0
    assert {r["size"] for r in got if r["doc_id"] in (3, 4)} == {16}
    hot = sharding.shard(spark.createDataFrame([(i, "same") for i in range(400)], "doc_id long, text string"), 8).groupBy("shard").count().collect()
    assert [r["count"] for r in hot] == [50] * 8  # a group larger than a shard is spread evenly
