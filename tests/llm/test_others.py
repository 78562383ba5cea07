"""Round trips, planted cases and held-out accuracy."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm import chat, decontaminate, langid, media, queries, toxicity
from tributary.llm.common import saved, table


# ---- decontamination ----

ITEMS = [(1, "If Alice has 12 apples and gives Bob 5 apples, how many apples does Alice have after giving Bob 5 apples today?"), (2, "short item of five words"), (3, None), (4, ""), (5, "12 34 56 78 90 12 34 56 78 90 12 34 56 78")]


def leaks(spark, docs, items=ITEMS):
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted(((r["doc_id"], r["item_id"], r["exact"]) for r in found.collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("shared", [2_000_000, 0])
def test_templates(spark, monkeypatch, shared):
    monkeypatch.setattr(decontaminate, "SHARED", shared)
    docs = [
        (1, "Noise. If Carol has 30 apples and gives Dan 7 apples, how many apples does Carol have after giving Dan 7 apples today? More"),
        (2, "x If Carol has 30 apples and gives Dan 7 apples, how many apples does Zed have after giving Quinn 9 apples today? More"),
        (3, "see short item of five words here"), (4, None), (5, ""), (6, "gives Bob 5 apples, how many apples does"), (7, "99 98 97 96 95 94 93 92 91 90 89 88 87 86 85"),
        (8, f"Before it. {ITEMS[0][1]} And after."), (8, f"Before it. {ITEMS[0][1]} And after."), (None, ITEMS[0][1]),
    ]
    assert leaks(spark, docs) == [(1, 1, False), (3, 2, True), (8, 1, True), (None, 1, True)]


def test_names_that_open_a_sentence(spark):
    """A capital at a sentence's start may be a name or not; both readings are hashed."""
    items = [(1, "Alice has 12 apples and gives Bob 5 more"), (2, "Compute 12 plus 34 now"), (3, "The sum of the first ten odd numbers is what? Maria asked her teacher this on every single day")]
    docs = [
        (1, "So it is. Carol has 30 apples and gives Dan 7 more today"), (2, "He said Carol has 30 apples and gives Dan 7 more today"), (3, "now compute 12 plus 34 now, please"),
        (4, "Find this: the sum of the first ten odd numbers is what? Ines asked her teacher this on every single day"), (5, "nothing has 30 apples and gives Dan 7 less"),
    ]
    assert [r[:2] for r in leaks(spark, docs, items)] == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_rows_without_or_with_repeated_ids_are_matched_each(spark):
    items = spark.createDataFrame([(1, "one item of exactly these seven words"), (1, "another item of the very same id"), (None, "an item without any id at all")], "item_id long, text string")
    texts = [(5, "one item of exactly these seven words"), (5, "clean text"), (5, "another item of the very same id"), (None, "see an item without any id at all"), (None, "clean too"), (None, "one item of exactly these seven words")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(map(tuple, decontaminate.matches(docs, items).select("doc_id", "item_id").collect()), key=repr)
    assert got == [(5, 1), (None, 1), (None, None)]
    assert sorted(r["text"] for r in decontaminate.keep_clean(docs, items).collect()) == ["clean text", "clean too"]


def test_units_and_numbers(spark):
    item = [(1, "a train travels 120 km in 3 hours so what is its average speed over the whole trip")]
    docs = [(1, "a train travels 75 miles in 2 days so what is its average speed over the whole trip"), (2, "a train travels many roads in summer so what are its usual speeds")]
    assert leaks(spark, docs, item) == [(1, 1, False)]


CASED = [(1, "The Heatou onont to the anor. Is Benli of Anor, or Kareth: the ulm? Orin went by Tamsel"), (2, "12 34 56 78"), (3, "Ada Bo Cy Di Ed Flo Gus Hal"), (4, "a train travels 120 km in 3 hours so what is its average speed over the whole trip"), (5, "où est l'été près de la grande straße")]


@pytest.mark.parametrize("shared", [2_000_000, 0])
def test_copies_in_other_case_and_punctuation(spark, monkeypatch, shared):
    monkeypatch.setattr(decontaminate, "SHARED", shared)
    docs = [
        (1, CASED[0][1].upper()), (2, "before it " + re.sub("[.,:?]", "", CASED[0][1]) + " and after"), (3, "in lower " + CASED[0][1].lower().replace(" ", " - ")),
        (4, "see 12, 34; 56 78!"), (5, "so ADA BO CY DI ED FLO GUS HAL came"), (6, "12 34 99 78"), (7, "Ada Bo Cy Zed Ed Flo Gus Hal"),
        (8, "BEFORE IT A TRAIN TRAVELS 75 MILES IN 2 DAYS SO WHAT IS ITS AVERAGE SPEED OVER THE WHOLE TRIP"), (9, "THIS IS A TEXT IN CAPITALS THAT HAS NOTHING OF ANY ITEM IN IT"), (10, CASED[4][1].upper().replace("'", "\u2019")),
    ]
    assert leaks(spark, docs, CASED) == [(1, 1, True), (2, 1, True), (3, 1, True), (4, 2, True), (5, 3, True), (8, 4, False), (10, 5, True)]


def test_upper_cased_benchmark_is_found(spark, data):
    items = table(spark, data, "benchmark")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("SO "), F.upper("text")).alias("text"))
    found = decontaminate.matches(docs, items).where("doc_id = item_id").count()
    assert found == items.count() > 0


def test_decontamination_finds_planted_items(spark, data):
    items = duckdb.sql(f"select item_id, text from '{data}/benchmark.parquet'").fetchall()
    docs = duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall()
    whole = {(d, i) for i, q in items for d, t in docs if " ".join(q.split()[1:]) in " ".join(t.split())}
    some = {(d, i) for i, q in items for d, t in docs if any(" ".join(q.split()[k : k + 12]) in " ".join(t.split()) for k in range(1, len(q.split()) - 11))}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontaminate(spark, data).collect()}
    assert whole and whole <= got <= some


class PlainMatcher:
    """Templates, windows and diagonals by plain Python, text by text."""

    SOLID = re.compile(rb"[0-9A-Za-z\x80-\xff]")
    UNITS = {u.encode() for u in decontaminate.UNITS}

    def template(self, text):
        raw = text.encode()
        words = [(m.group(), m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        out = []
        for k, (w, a, _) in enumerate(words):
            m = self.SOLID.search(w)
            body = w[m.start() :] if m else b""
            value = re.sub(rb"[^0-9a-z\x80-\xff]", b"\0", body.lower()).rstrip(b"\0") if m else None
            before = words[k - 1] if k else None
            opens = before is None or before[0][-1:] in b"!.:?" or b"\n" in raw[before[2] : a]
            capital = bool(re.match(rb"[A-Z]|\xc3[\x80-\x9e]", body))
            quiet = bool(re.search(rb"[a-z]|\xc3[\x9f-\xbf]", w))
            out.append({"value": value, "number": body[:1].isdigit() if m else False, "capital": capital, "opens": opens, "quiet": quiet})
        k = 0
        while k < len(out):  # passages in capitals
            n = next((j for j in range(k, len(out)) if out[j]["quiet"] != out[k]["quiet"]), len(out)) - k
            run = out[k : k + n]
            if not run[0]["quiet"] and 2 * sum(x["capital"] for x in run) > n and (n >= decontaminate.WINDOW or n == len(out)):
                for x in run:
                    x["capital"] = False
            k += n
        symbols = []
        for k, x in enumerate(out):
            unit = k > 0 and out[k - 1]["number"] and x["value"] in self.UNITS
            first = "unit" if unit else "name" if x["capital"] and not x["opens"] else "number" if x["number"] else x["value"]
            second = "name" if x["capital"] and x["opens"] and not unit else first
            symbols.append((first, second, x["value"]))
        return symbols

    def windows(self, text, size):
        """(reading, symbols, first word, {place: value of a placeholder})."""
        t = self.template(text)
        for k in range(len(t) - size + 1):
            for reading in (0, 1):
                part = t[k : k + size]
                slots = {j: x[2] for j, x in enumerate(part) if x[reading] is None or isinstance(x[reading], str)}
                if size - len(slots) >= decontaminate.LITERALS:
                    yield reading, tuple(x[reading] for x in part), k, slots

    def folded(self, text):
        text = text.lower() if text.isascii() else decontaminate._MARKS.sub("", text.casefold())
        return re.sub(rb"[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]", b"", text.encode()).split()

    def match(self, doc, item):
        best = []
        n = len(self.template(item))
        places: dict = {}
        for r, s, k, slots in self.windows(item, min(decontaminate.WINDOW, n)) if n else ():
            places.setdefault(s, []).append((r, k, slots))
        kinds = {}
        for q, s, k, slots in self.windows(doc, min(decontaminate.WINDOW, n)) if places else ():
            for r, p, own in places.get(s, ()):
                if len(own) == len(slots):
                    covered, pairs = kinds.setdefault((r, q), {}).setdefault(k - p, (set(), set()))
                    covered.update(range(p, p + len(s)))
                    pairs.update((p + j, own[j], d) for j, d in zip(sorted(own), [slots[j] for j in sorted(slots)], strict=True))
        best += [self.total(lines, n, True) for lines in kinds.values()]
        f, d = self.folded(item), self.folded(doc)
        size, lines = min(decontaminate.WINDOW, len(f)), {}
        for k in range(len(d) - size + 1) if f else ():
            for p in range(len(f) - size + 1):
                if f[p : p + size] == d[k : k + size]:
                    lines.setdefault(k - p, (set(), set()))[0].update(range(p, p + size))
        best.append(self.total(lines, len(f), False))
        return max((b for b in best if b), default=None)

    def total(self, lines, n, template):
        hit = slots = agree = same = 0
        for covered, pairs in lines.values():
            by = {}
            for _, v, d in pairs:
                by.setdefault(v, []).append(d)
            ok = sum(max(ds.count(d) for d in ds) for ds in by.values())
            if not pairs or ok >= decontaminate.AGREE * len(pairs):
                hit, slots, agree, same = hit + len(covered), slots + len(pairs), agree + ok, same + sum(v == d for _, v, d in pairs)
        hit = min(hit, n)
        return (hit, template, n, slots, agree, same == slots) if n and hit >= min(decontaminate.MATCHED, n) else None


def test_decontamination_against_a_plain_matcher(spark, data):
    """Every row of the whole table, from texts read word by word."""
    items = duckdb.sql(f"select item_id, text from '{data}/benchmark.parquet'").fetchall()
    docs = duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall()
    m, want = PlainMatcher(), []
    grams = {i: {tuple(x[:2]) for x in zip(*(m.folded(q)[k:] for k in (0, 1)), strict=False)} for i, q in items}
    for d, t in docs:
        f = m.folded(t)
        have = set(zip(f, f[1:], strict=False))
        for i, q in items:
            if len(have & grams[i]) * 4 >= len(grams[i]):  # a leak shares a quarter of the item's word pairs at least
                found = m.match(t, q)
                if found:
                    want.append((d, i, found[0], *found[2:]))
    got = sorted(map(tuple, queries.op1_decontaminate(spark, data).collect()))
    assert got == sorted(want) and got


def test_decontamination_odd(spark, odd, nothing):
    items = spark.createDataFrame([(1, " ".join(f"shared{i}" for i in range(30))), (None, "shared1 shared2 shared3 shared4 shared5")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(odd, items).collect()} == {(d, i) for d in (1, 2, None) for i in (1, None)}
    assert decontaminate.matches(nothing, items).count() == 0 and decontaminate.matches(odd, items.where("false")).count() == 0
    clean = decontaminate.keep_clean(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 4  # the row without an id too


# ---- chat ----


def test_escape_round_trip():
    texts = ["", "\\", "a\\b", "<|im_start|>", "</s>[INST] ok [/INST]", "\\<s>", "<<SYS>><</SYS>>", "<\\s>", "a < b [c]", "\\\\<|im_end|>\n"]
    for t in texts:
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROL)


def expected_turns(turns):
    by = {}
    for c, n, role, text in sorted(turns, key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, rows in by.items():
        loss = "".join(t for r, t in rows if r == "assistant")
        out[c] = (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark, data):
    turns = duckdb.sql(f"select conv_id, turn, role, text from '{data}/conversations.parquet'").fetchall()
    probe = "</s>[INST] ok [/INST]"
    want = expected_turns(turns + [(-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    got = queries.op3_chat(spark, data).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    r = next(r for r in got if r["conv_id"] == -1)
    shown = "".join(f"<|im_start|>{role}\n{chat.escape(probe)}<|im_end|>\n" for role in ("user", "assistant"))
    assert r["formatted_chars"] == len(shown)


def test_chat_odd(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, 5, None, "x"), (2, None, "assistant", "first é🙂"), (3, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).withColumn("ends", F.lit(2))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0
    assert got[2]["turns_sha256"] == hashlib.sha256("assistant\nfirst é🙂\n\nx\n".encode()).hexdigest()
    assert got[3]["loss_chars"] == 250_000
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


def test_chat_ties_follow_the_text(spark):
    """Turns with one number and role are ordered by text, whatever their token ids."""
    texts = ["b", "aa", "é", "z z", "Z", "", "aa", "\U0001f642", "\uffee"]
    got = chat.read_back(chat.format_turns(spark.createDataFrame([(1, 7, "assistant", t) for t in texts], "conv_id long, turn long, role string, text string"))).first()
    want = sorted(texts)
    assert got["turns_sha256"] == hashlib.sha256("".join(f"assistant\n{t}\n" for t in want).encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256("".join(want).encode()).hexdigest()


# ---- language identification ----


def test_langid_held_out(spark):
    big = "/root/testdata/sf0.01"
    got = queries.op5_langid(spark, big).join(table(spark, big, "documents").select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["rejected"] for r in got) <= 0.01 * len(got)


def test_langid_odd(spark, odd, nothing):
    model = langid.fit(odd)
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[13]["lang_pred"] == "und" and got[13]["score"] == 0
    assert got[10]["lang_pred"] in ("en", "fr")
    empty = langid.fit(nothing)
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.where("text is null or doc_id = 13").count() == 0 and kept.where("doc_id = 8").count() == 1
    assert langid.identify(nothing, model).count() == 0


def test_langid_learns_rare_languages_and_different_texts(spark):
    """Every language is learnt, and copies of one text do not crowd the sample out."""
    many = [(f"l{k:04}", " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}x{i}" for i in range(30))) for k in range(1200)]
    copies = [("aa", "the same words again")] * 3000 + [("aa", f"text {i} of its own {i * i}") for i in range(300)]
    model = langid.fit(spark.createDataFrame(many + copies, "lang string, text string"), sample=100)
    assert model.languages == sorted({k for k, _ in many} | {"aa"})
    assert (model.owner == 0).sum() == langid.CENTROIDS


def test_langid_rejects_short_texts_by_the_same_rule(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    ru = "Съешь же ещё этих мягких французских булок, да выпей чаю"
    texts = [(1, ru), (2, ru * 50), (3, "привет"), (4, " ".join(docs.where("lang = 'en'").first()["text"].split()[:12]))]
    got = {r["doc_id"]: r["rejected"] for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_ngram_counts_match_a_plain_loop():
    text = "Ab é, AB\n1é"
    import pyarrow as pa

    ((_, _, c),) = langid.counts(pa.array([text]))
    folded = bytes(langid._FOLD[b] for b in text.lower().encode())
    assert c.sum() == sum(folded[i : i + n].strip() != b"" for n in (1, 2, 3) for i in range(len(folded) - n + 1))


# ---- toxicity ----


def test_toxicity_held_out(spark):
    """Accuracy, evidence and calibration on rows whose labels were not learnt."""
    big = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, big).join(table(spark, big, "labels"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit / sum(r["toxic"] for r in got) > 0.9 and hit / sum(r["predicted"] for r in got) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert np.mean([bool(r["evidence"]) and r["closeness"] > 0 for r in got]) > 0.99
    score, label = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got])
    edges = np.quantile(score, np.linspace(0, 1, 11))
    bins = np.clip(np.searchsorted(edges, score, "right") - 1, 0, 9)
    assert sum(abs((score - label)[bins == k].sum()) for k in range(10)) / len(got) < 0.03  # expected calibration error


def plain_terms(text):
    out = {}
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        m = re.search(rb"[0-9A-Za-z\x80-\xff]", w)
        if m:
            body = re.sub(rb"[^0-9a-z\x80-\xff]", b"\0", w[m.start() :].lower())
            keys = [body.rstrip(b"\0")] + [(n, body[:n].rstrip(b"\0")) for n in toxicity.PREFIXES if len(body) > n]
            for k in keys:
                out[k] = out.get(k, 0) + 1
    return out


def test_toxicity_against_all_cosines(spark, data, documents):
    """Every score of the whole table from plain dictionaries and every pair of a text and an example."""
    label = {}
    for i, y in duckdb.sql(f"select doc_id, toxic from '{data}/labels.parquet' where toxic is not null").fetchall():
        label[i] = max(y, label.get(i, 0))
    label = {i: y for i, y in label.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    text = {d[0]: plain_terms(d[1]) for d in documents}
    ids = table(spark, data, "labels").where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) != 2)
    number = toxicity.fit(table(spark, data, "documents"), ids).ids.tolist()  # only which example comes first where cosines tie
    assert sorted(number) == sorted(i for i in label if i in text)
    seen = {}
    for i in number:
        for t in text[i]:
            seen.setdefault(t, []).append(label[i])
    known = sorted((t for t, ys in seen.items() if len(ys) >= toxicity.MIN_EXAMPLES), key=repr)
    column = {t: k for k, t in enumerate(known)}
    df, n, toxic = dict.fromkeys(known, 0), len(number), sum(label[i] for i in number)
    for terms in text.values():
        for t in terms:
            if t in df:
                df[t] += 1
    weight = []
    for t in known:
        a, b = sum(seen[t]), len(seen[t]) - sum(seen[t])
        c, d = toxic - a, n - toxic - b
        chi = n * max(abs(a * d - b * c) - n / 2, 0) ** 2 / ((a + b) * (c + d) * toxic * (n - toxic))
        weight.append(np.log((len(text) + 1) / df[t]) * (toxicity.FLOOR + chi / (chi + toxicity.HALF)))
    v = {}
    for i, terms in text.items():
        x = np.zeros(len(known))
        for t, uses in terms.items():
            if t in column:
                x[column[t]] = (1 + np.log(uses)) * weight[column[t]]
        v[i] = x / max(np.linalg.norm(x), 1e-12)
    examples, y = np.stack([v[i] for i in number]), np.array([label[i] for i in number], float)
    rate = toxic / sum(1 for _ in label)

    def odds(cos):
        cos = np.round(cos, 9)
        near = [k for k in sorted(range(n), key=lambda k: (-cos[k], k))[: toxicity.NEIGHBOURS] if cos[k] > 0]
        yes, all_ = sum(cos[k] ** toxicity.CLOSENESS * y[k] for k in near), sum(cos[k] ** toxicity.CLOSENESS for k in near)
        return np.log(yes + 0.1 * rate) - np.log(all_ - yes + 0.1 * (1 - rate)), [number[k] for k in near]

    own = examples @ examples.T
    np.fill_diagonal(own, 0)
    shift, slope = toxicity.fitted_curve(np.array([odds(c)[0] for c in own]), y, np.ones(n))
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, data).collect()}
    assert len(got) == len(documents)
    for i, r in got.items():
        x, near = odds(examples @ v[i])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-shift - slope * x)) if near else rate, abs=1e-6)
        assert list(r["evidence"]) == near[:3]


def test_nearest_is_exact():
    rng = np.random.default_rng(5)

    def entries(n, terms):
        counts = rng.poisson(0.15, (n, terms)) * (rng.random(n) > 0.05)[:, None]
        doc, term = np.nonzero(counts)
        return doc, term, toxicity.unit(doc, counts[doc, term], np.ones(len(term)), n)

    doc, term, v = entries(700, 40)
    full = np.zeros((700, 40))
    full[doc, term] = v
    index = toxicity.Index.of(doc, term, v, 700, 40)
    d, t, q = entries(60, 40)
    ask = np.zeros((60, 40))
    ask[d, t] = q
    for skip in (None, np.arange(60)):
        cos, who = index.nearest(d, t, q, 60, toxicity.NEIGHBOURS, skip)
        want = np.round(ask @ full.T, 9)
        if skip is not None:
            want[np.arange(60), skip] = 0
        order = np.lexsort((np.broadcast_to(np.arange(700), want.shape), -want), axis=1)[:, : toxicity.NEIGHBOURS]
        best = np.take_along_axis(want, order, 1)
        assert cos == pytest.approx(best, abs=2e-9)
        assert (who == np.where(best > 0, order, -1))[np.abs(cos - best).max(1) == 0].all()


def test_toxicity_odd(spark, odd, nothing, monkeypatch):
    monkeypatch.setattr(toxicity, "MIN_EXAMPLES", 1)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (6, None), (99, 1), (7, 0), (12, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert sorted(model.ids.tolist()) == [1, 2, 7, 12]  # an id that repeats is one example
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(odd, labels.where("false"))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.0}
    blank = toxicity.fit(odd.where("doc_id in (3, 4)"), spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(odd, blank).collect()} == {0.5}


# ---- media ----


def test_media_round_trip(spark, data, documents):
    got = {r["doc_id"]: r for r in queries.op9_media(spark, data).collect()}
    assert len(got) == len(documents)
    for i, text, *_ in documents:
        raw = text.encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        stored = media.encode(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["position"] == 1 and r["caption"] == f"payload of {len(raw)} bytes"
        mean = sum(padded) / len(padded)
        spread = (sum((x - mean) ** 2 for x in padded) / len(padded)) ** 0.5
        quarters = [sum(64 * q <= x < 64 * q + 64 for x in padded) / len(padded) for q in range(4)]
        size, m, d, q = re.fullmatch(r"(\w+);mean=([\d.]+);std=([\d.]+);(.*)", r["feature"]).groups()
        assert size == f"24x{len(padded) // 24}" and [float(m), float(d), *map(float, q.split(","))] == pytest.approx([mean, spread, *quarters], abs=1e-4)


def test_media_are_stored_once_and_read_from_storage(spark):
    texts = [(i, "the same text" if i % 3 else f"text {i}") for i in range(90)] + [(None, None), (1, "a repeated id")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    stored = media.store(docs, "text")
    assert stored.inputFiles() and stored.where("digest = '%s'" % hashlib.sha256(b"the same text").hexdigest()).count() <= 2
    found = {r["digest"]: r for r in media.resolved_payloads(stored).collect()}
    assert set(found) == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts}
    back = {r["digest"]: bytes(r["media"]) for r in stored.collect()}
    assert all(media.decode(back[hashlib.sha256(t.encode()).hexdigest()]).tobytes().startswith(t.encode()) for _, t in texts if t)


def test_page_sequences(spark, data):
    """Text runs of real pages hold the words that are left when tags, scripts, styles and titles go, in order."""
    import html as entities

    for r in media.parse(table(spark, data, "pages"), "page_id", "html").join(table(spark, data, "pages"), F.col("id") == F.col("page_id")).collect():
        plain = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>|<!DOCTYPE[^>]*>|<[^<>]*>", " ", r["html"] or "")
        assert "".join("".join(x["text"] for x in r["items"]).split()) == "".join(entities.unescape(plain).split())
        assert [x["position"] for x in r["items"]] == list(range(len(r["items"])))
    assert queries.page_sequences(spark, data).count() == table(spark, data, "pages").count()


def test_media_sequence():
    page = "<p>One &amp; two</p><img src='media:aa' alt='A'>mid<script>x('<img src=no>')</script><figure><img src='media:bb'><figcaption>cap <b>B</b></figcaption></figure><p>end"
    items = media.sequence(page)
    assert [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in items] == [
        (0, "text", "One & two", None, None), (1, "media", None, "aa", "A"), (2, "text", "mid", None, None), (3, "media", None, "bb", "cap B"), (4, "text", "end", None, None)
    ]
    assert media.sequence(None) == media.sequence("") == []


def test_captions_stay_with_their_figure():
    short = lambda page: [(x["kind"][0], x["text"] if x["kind"] == "text" else x["caption"]) for x in media.sequence(page)]
    assert short("<img src=a alt=A><p>x<figcaption>stray</figcaption>") == [("m", "A"), ("t", "xstray")]
    assert short("<figure><img src=a><figcaption>cap</figure><p>rest") == [("m", "cap"), ("t", "rest")]
    assert short("<figure><img src=a><figcaption>cap<p>rest</p><img src=b alt=B>") == [("m", "cap"), ("t", "rest"), ("m", "B")]
    assert short("<figure><img src=a><figcaption><p>one</p><p>two</p></figcaption></figure>end") == [("m", "one\ntwo"), ("t", "end")]
    assert short("<figure><figure><img src=a><figcaption>in</figcaption></figure><img src=b><figcaption>out</figcaption></figure>") == [("m", "in"), ("m", "out")]
    assert short("<figure><img src=a><figcaption>one<figure><img src=b><figcaption>two") == [("m", "one"), ("m", "two")]
    assert short("<title>head</title><p>body") == [("t", "body")]


def test_media_resolve_keeps_order_and_captions(spark, odd, nothing):
    pages = spark.createDataFrame([(1, "<img src='media:aa' alt='x'><img src='media:zz' alt='y'><img src='media:aa' alt='z'>"), (2, None)], "page_id long, html string")
    refs = media.references(media.parse(pages, "page_id", "html"))
    got = media.resolve(refs, spark.createDataFrame([("aa", 5)], "digest string, n long")).orderBy("position").collect()
    assert [(r["caption"], r["n"]) for r in got] == [("x", 5), ("y", None), ("z", 5)]
    made = media.resolved_payloads(media.store(odd, "text")).collect()
    assert len(made) == len({r["text"] or "" for r in odd.collect()}) and {r["payload_bytes"] for r in made if r["n_bytes"] == 0} == {576}
    assert media.resolved_payloads(media.store(nothing, "text")).count() == 0 and media.parse(nothing, "doc_id", "html").count() == 0


# ---- pipeline ----


def test_pipeline(spark, data):
    docs = table(spark, data, "documents")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        docs = saved(stage(spark, docs, data), f"test-{name}")
        sizes.append(docs.count())
        assert docs.columns == columns + ["shard", "slot"] * (name == "shards")
        assert {(r["doc_id"], r["text"]) for r in docs.collect()} <= before
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in docs.collect()]
            assert len(ids) == len(set(ids))
            first = {r["component_id"] for r in queries.op7_ngram_join(spark, data).collect()}
            assert set(ids) <= first
        if name == "benchmark_decontamination":
            assert decontaminate.matches(docs, table(spark, data, "benchmark")).count() == 0
    assert sizes[1] > 0.98 * sizes[0] and sizes[3] < sizes[2] < sizes[1] and sizes[5] == sizes[4]
    assert sorted(r["slot"] for r in docs.where("shard = 0").collect()) == list(range(docs.where("shard = 0").count()))


def test_stages_on_odd_and_empty_tables(spark, data, odd, nothing):
    """Nulls, ties, repeats and clashing names pass every stage; distinct clean texts stay."""
    last = ["shard", "slot"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, data)
        want = odd.columns if name != "shards" else [c for c in odd.columns if c not in last] + last
        assert out.columns == want
        rows = out.collect()
        texts = {r["text"] for r in rows}
        have = {r["text"] for r in odd.collect()}
        if name == "language_id":
            have -= {None, "", " \t\n ", "1234 !!! ???"}
        if name == "near_duplicates":
            have -= {r["text"] for r in rows if r["doc_id"] == 1} | {t for t in have if t and t.startswith("shared0")}
            texts -= {t for t in texts if t and t.startswith("shared0")}
        if name in ("source_mixing",):  # what a source's target leaves out may be missing
            assert texts <= have
        else:
            assert texts == have
        empty = stage(spark, nothing, data)
        assert empty.count() == 0 and empty.columns == want


def test_every_operator_is_registered():
    assert sorted(int(m[1]) for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))
