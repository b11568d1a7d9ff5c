"""Perplexity bands, periodic runs and the term scan against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from test_llm_operators import corpus, frame

from workmill.llm import kneser_ney, periodic_runs, queries, term_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


# Periodic runs


def all_runs(w, least=12):
    best = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                best.setdefault((i, j + p), p)
            i = max(i + 1, j)
    return sorted((b, e - b, p) for (b, e), p in best.items())


def periodic_text(rng):
    """Words with runs of many kinds: nested, touching out of phase, nearly periodic, none."""

    def word(depth):
        if not depth:
            return [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 8))]
        return [x for _ in range(rng.randint(1, 4)) for x in word(depth - 1) * rng.choice([1, 1, 2, 3, rng.randint(1, 12)])]

    kind = rng.random()
    if kind < 0.15:
        return [rng.choice("ab") for _ in range(rng.randint(0, 300))]
    if kind < 0.25:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randint(3, 10)):
            a, b = b, b + a
        return b
    w = word(rng.randint(1, 3))[:500]
    if rng.random() < 0.5:
        w = (w[: rng.randint(1, len(w))] * rng.randint(2, 5))[:1000]
        w[rng.randrange(len(w))] = rng.choice("az")
    if rng.random() < 0.4:
        root = [rng.choice("ab") for _ in range(rng.randint(1, 6))]
        x = (root * 100)[: rng.randint(5, 400)]
        w = w + x + x[rng.randint(0, len(root)) :] + w
    return w[:1000]


def test_runs_of_equal_brute_force():
    for seed in range(120):
        rng = random.Random(seed)
        texts = [periodic_text(rng) for _ in range(rng.randint(0, 6))]
        text, first, length, period = periodic_runs.runs_of([[x.encode() for x in t] for t in texts])
        got = list(zip(text.tolist(), first.tolist(), length.tolist(), period.tolist(), strict=True))
        assert got == [(k, *r) for k, t in enumerate(texts) for r in all_runs(t)], seed


def test_runs_at_the_least_length_and_across_a_seam():
    seam = [*"baaab"] * 90 + [*"baabb"] * 96  # two regions of period 5 that touch out of phase
    for w in ([*"ab"] * 6, [*"ab"] * 5 + ["a"], ["x"] * 12, ["x"] * 11, seam):
        got = [tuple(map(int, r)) for r in zip(*periodic_runs.runs_of([[x.encode() for x in w]])[1:], strict=True)]
        assert got == all_runs(w)


def expected_runs(words):
    found = all_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        len(found),
        *best,
        1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def planted_words(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


RUN_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs_query(spark, tmp_path):
    texts, _ = corpus(5, rows=150)
    rng = random.Random(2)
    texts += [" \n ".join(periodic_text(rng)) for _ in range(60)] + ["é à " * 30 + "\vtail"]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(queries.op12_periodic_runs(lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")))
    assert len(got) == len(texts)
    planted = 0
    for i, t in enumerate(texts):
        own = WORD.findall(t or "")
        words = planted_words(i, own)
        planted += words != own
        assert tuple(got[i][c] for c in RUN_COLUMNS) == expected_runs(words), (i, t)
    assert planted


def test_find_runs_passes_rows_through(spark):
    texts = ["a b " * 10 + "end", None, "", "one two", "a b " * 10 + "end", "long " + "w x y z " * 30_000]
    out = periodic_runs.find_runs(frame(spark, texts, ids=[1, 2, 3, 4, 1, None]))
    assert {"n_words", "kept", "score", "collapsed"} <= set(out.columns) and dict(out.dtypes)["n_words"] == "bigint"
    rows = out.collect()
    assert sorted((r.n_words, r.n_runs, r.collapsed) for r in rows if r.text and len(r.text) < 100) == [(2, 0, "one two"), (21, 1, "a b end"), (21, 1, "a b end")]
    assert [(r.n_runs, r.length, r.period, r.collapsed) for r in rows if r.doc_id is None] == [(1, 120_000, 4, "long w x y z")]
    assert [(r.n_words, r.n_runs, r.start, r.collapsed) for r in rows if r.doc_id == 2] == [(0, 0, None, None)]
    assert periodic_runs.find_runs(frame(spark, [])).count() == 0


# Ranked lexical search


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def best_documents(docs, items, top):
    lists = [(i, terms(t)) for i, t in docs]
    lists = [(i, ts, Counter(ts)) for i, ts in lists if ts]
    n_docs, n_terms = len(lists), sum(len(ts) for _, ts, _ in lists)
    held = Counter(t for _, _, c in lists for t in c)
    wanted = defaultdict(Counter)
    for item, text in dict.fromkeys(items):
        wanted[item].update(terms(text))
    out = []
    for item, uses in wanted.items():
        scores = []
        for i, ts, c in lists:
            m = 100 - 25 + (25 * len(ts) * n_docs) // n_terms
            weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) for t in uses}
            score = sum(k * weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in uses.items())
            if score > 0:
                scores.append((score, i))
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(scores[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("top", "block"), [(5, 1 << 18), (3, 40), (400, 200)])
def test_term_scan(spark, top, block):
    texts, shared = corpus(9, rows=120)
    ids = [*range(len(texts) - 1), None]
    texts[3], texts[4] = "É one-two ONE_Two3 été\x00Été", "x" * 50_000 + " w1"
    texts.append("w1 w2 " * 20_000)
    ids.append(7)  # an id that comes twice
    items = [(1, " ".join(shared[:30])), (2, "W1 w2, w1! W4"), (3, None), (4, "..."), (5, "nowhere"), (2, "W1 w2, w1! W4"), (2, "été one"), (None, "two3 wé2"), (6, " ".join(texts[7].split()[:2000]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = term_scan.rank(frame(spark, texts, ids), table, top=top, block=block)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == best_documents(list(zip(ids, texts, strict=True)), items, top)


def test_term_scan_empty(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert term_scan.rank(none, items).count() == 0
    assert term_scan.rank(frame(spark, ["a b", None, ""]), items.limit(0)).count() == 0
    assert term_scan.rank(frame(spark, [None, "", "."]), items).count() == 0


# Perplexity


def counts_of(text):
    text = text or ""
    own = WORD.findall(text)
    three = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    covered = {i + k for i in range(len(own) - 2) if three[tuple(own[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


class PlainModel:
    """Modified Kneser-Ney over bytes, by the textbook and with dictionaries."""

    def __init__(self, texts, order=5):
        self.order, counts = order, Counter()
        for t in texts:
            b = bytes(order - 1) + t
            counts.update(b[i : i + order] for i in range(len(b) - order + 1))
        self.tables = {order: counts}
        for k in range(order - 1, 0, -1):
            self.tables[k] = Counter(g[1:] for g in self.tables[k + 1])
        self.discount, self.all, self.kinds = {}, {}, {}
        for k, table in self.tables.items():
            n = Counter(table.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
            d = [j - (j + 1) * y * n[j + 1] / n[j] if n[1] and n[j] else 0 for j in (1, 2, 3)]
            self.discount[k] = [0, *[x if 0 < x < j else j / 2 for j, x in enumerate(d, 1)]]
            self.all[k], self.kinds[k] = Counter(), defaultdict(Counter)
            for g, c in table.items():
                self.all[k][g[:-1]] += c
                self.kinds[k][g[:-1]][min(c, 3)] += 1

    def p(self, gram):
        if not gram:
            return 1 / 256
        k, context = len(gram), gram[:-1]
        below = self.p(gram[1:])
        if not self.all[k][context]:
            return below
        c = self.tables[k][gram]
        back = sum(self.discount[k][j] * n for j, n in self.kinds[k][context].items())
        return (c - self.discount[k][min(c, 3)] + back * below) / self.all[k][context] if c else back * below / self.all[k][context]

    def bits(self, t):
        b = bytes(self.order - 1) + t
        return -sum(math.log2(self.p(b[i : i + self.order])) for i in range(len(b) - self.order + 1)) / len(t)


def prepared(text):
    return re.sub(rb"[0-9]", b"0", re.sub(rb"[\x00\t-\r]", b" ", text.encode()))


def quality_corpus(rows=90):
    rng = random.Random(4)
    syllables = {"aa": ["ba", "lo", "mi", "ten", "sur", "eé"], "bb": ["ksch", "oor", "ij", "aan", "ver", "u"], None: ["zi", "xo", "12", "qa"]}
    out = []
    for k in range(rows):
        lang = ("aa", "aa", "bb", None)[k % 4]
        word = lambda: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))  # noqa: E731, B023
        text = " ".join(word() + rng.choice(["", "", ",", ".\n"]) for _ in range(rng.choice([20, 60, 90, 200])))
        if k % 11 == 5:
            text = " ".join(w + "***" for w in text.split())
        if k % 13 == 6 and out:
            text = out[-4][0] if k % 4 == (k - 4) % 4 and len(out) > 3 else text
        out.append((text, lang))
    return [*out, ("", "aa"), (None, "bb"), ("one", "cc"), ("yy " * 80, "cc"), ("solo " + " ".join(f"w{i}q" for i in range(60)), "dd")]


def judged(spark, rows, **options):
    data = [(i, t, lang, "clash", True) for i, (t, lang) in enumerate(rows)]
    return kneser_ney.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, n_words string, kept boolean").repartition(4), **options)


def test_kneser_ney(spark):
    rows = quality_corpus()
    halves = [r.half for r in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i long, text string").orderBy("i").select(kneser_ney._half(0)).collect()]
    counts = [counts_of(t) for t, _ in rows]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
    trains = [not f and 10 * c[2] <= c[0] for f, c in zip(failed, counts, strict=True)]
    bits = []
    for lang in {lang for _, lang in rows}:
        for half in (0, 1):
            model = PlainModel([prepared(t) for k, (t, own) in enumerate(rows) if trains[k] and own == lang and halves[k] == half])
            bits += [(k, model.bits(prepared(t))) for k, (t, own) in enumerate(rows) if t and own == lang and halves[k] != half]
    bits = dict(bits)
    got = rows_of(judged(spark, rows, tail=100))
    assert len(got) == len(rows)
    for k, (text, _) in enumerate(rows):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*counts[k], failed[k]), k
        assert (r.bits_per_byte is None) == (not text) and (not text or abs(r.bits_per_byte - bits[k]) < 0.002), k
    for lang in {lang for _, lang in rows}:
        levels = sorted({(rows[k][0], got[k].bits_per_byte) for k in got if rows[k][1] == lang and trains[k]}, key=lambda x: x[1])
        levels = [x[1] for x in levels]
        n = len(levels)
        low = min((v for i, v in enumerate(levels) if 1000 * (i + 1) > 100 * n), default=None)
        high = min((v for i, v in enumerate(levels) if 1000 * (i + 1) >= 900 * n), default=None)
        for k in got:
            if rows[k][1] == lang:
                assert got[k].kept == (not failed[k] and (low is None or low <= got[k].bits_per_byte <= high)), k
    marked = [k for k, (t, _) in enumerate(rows) if t and t.count("***") > 20 and not failed[k]]
    assert marked and not any(got[k].kept for k in marked)


def test_kneser_ney_slices_and_columns(spark):
    rows = quality_corpus(40)
    model = kneser_ney.fit(spark.createDataFrame([(t, lang) for t, lang in rows], "text string, lang string"))
    bound = model.where("bucket < 0").count() + model.where("bucket >= 0").count() // 3
    assert len(kneser_ney._slices(model, bound)) in (3, 4, 5) and len(kneser_ney._slices(model, 1 << 23)) == 1
    whole, sliced = judged(spark, rows), judged(spark, rows, bound=bound)
    assert {"doc_id", "text", "lang", "n_words", "kept"} <= set(whole.columns) and dict(whole.dtypes)["n_words"] == "bigint"
    assert sorted(map(str, whole.collect())) == sorted(map(str, sliced.collect()))
    assert judged(spark, []).count() == 0
    assert "text" not in judged(spark, rows[:5], texts=False).columns


def test_kneser_ney_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(" ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(n)), "aa") for n in (50, 70, 60_000, 80)]
    whole = [r.bits_per_byte for r in judged(spark, rows).orderBy("doc_id").collect()]
    blobs = [t.encode() for t, _ in rows]
    monkeypatch.setattr(kneser_ney, "_PIECE", 1000)
    pieces = Counter(int(k) for keys, _ in kneser_ney._runs(blobs, [0] * 4) for k in keys)
    monkeypatch.undo()
    assert pieces == Counter(int(k) for keys, _ in kneser_ney._runs(blobs, [0] * 4) for k in keys)
    assert len(whole) == 4 and all(b > 1 for b in whole)
