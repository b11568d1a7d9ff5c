"""Every operator against brute force on small tables with odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from workmill.llm import best_fit_packing, compression_toxicity, fm_decontamination, language_backoff, ngram_jaccard, pruned_graph, redirect_blocks, sketch_dedup, text_density, warc_index
from workmill.llm.common import distinct_sample
from workmill.llm.components import components
from workmill.llm.queries import RULES, tokenizer_path

DOCS = "doc_id long, text string, n_words string, spans int, kept int, score string"


def corpus(seed=1, rows=70):
    """Texts with copies, near copies, shared passages, odd bytes and long ones."""
    rng = random.Random(seed)
    vocabulary = [f"W{k}" if k % 3 else f"wé{k}." for k in range(160)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, out = fresh(40), []
    for _ in range(rows):
        kind = rng.random()
        if kind < 0.25 and out:
            text = rng.choice(out)
        elif kind < 0.5 and out:
            own = rng.choice(out).split()
            for _ in range(rng.randint(1, 3)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text = " ".join(own)
        elif kind < 0.75:
            text = " ".join(fresh(rng.randint(0, 30)) + shared[: rng.randint(10, 40)] + fresh(rng.randint(0, 30)))
        else:
            text = " \n\t".join(fresh(rng.choice([1, 3, 12, 13, 60, 2000])))
        out.append(text)
    return out + ["", " ", "...", "w1", None], shared


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "clash", 1, 2, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def jaccard_groups(texts, width, percent):
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_ngram_jaccard(spark, width, percent):
    texts, _ = corpus(3)
    got = by_id(ngram_jaccard.near_duplicates(frame(spark, texts), width, percent), "n_shingles", "component_id")
    assert got == jaccard_groups(texts, width, percent)


def test_ngram_jaccard_chain_and_odd_ids(spark):
    base = [f"t{k}" for k in range(60)]
    chain = [" ".join(base[:k] + [f"x{j}" for j in range(k)] + base[k:]) for k in range(6)]  # neighbours link, ends do not
    got = by_id(ngram_jaccard.near_duplicates(frame(spark, chain)), "n_shingles", "component_id")
    assert got == jaccard_groups(chain, 4, 85)
    odd = ngram_jaccard.near_duplicates(frame(spark, ["a b c d", "a b c d", "a b c d"], [None, 7, 7]))
    assert sorted(map(tuple, odd.collect()), key=str) == [(7, 1, 7), (7, 1, 7), (None, 1, None)]
    assert ngram_jaccard.near_duplicates(frame(spark, [])).count() == 0


def removed(texts, width):
    first, out = {}, {}
    for i, text in enumerate(texts):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first.setdefault(tuple(w[k : k + width]), i) < i:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (str(len(w)) and len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_sketch_dedup(spark):
    texts, _ = corpus(5)
    df = sketch_dedup.remove_repeats(frame(spark, texts))
    assert by_id(df, "n_words", "n_removed", "kept_sha256") == removed(texts, 13)
    for row in df.collect():
        assert row.score == "x" and (row.kept == row.text if not row.n_removed else len(row.kept.split()) == row.n_words - row.n_removed)


def test_sketch_dedup_odd_ids(spark):
    text = " ".join(f"q{k}" for k in range(20))
    got = sketch_dedup.remove_repeats(frame(spark, [text] * 4, [None, 4, 4, 9])).select("doc_id", "n_removed")
    assert sorted(map(tuple, got.collect()), key=str) == [(4, 0), (4, 0), (9, 20), (None, 0)]
    assert sketch_dedup.remove_repeats(frame(spark, [])).count() == 0


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(texts, items, width):
    windows = defaultdict(set)
    for name, text in items:
        w = WORD.findall((text or "").encode().lower())
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[k : k + width])].add(str(name))
    out = {}
    for i, text in enumerate(texts):
        w = WORD.findall((text or "").encode().lower())
        hit, names = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit[k : k + n], names = [1] * n, names | found
        out[i] = (len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), sum(hit) > 0)
    return out


@pytest.mark.parametrize("block", [200_000, 7])
def test_fm_decontamination(spark, block):
    texts, shared = corpus(7)
    items = [(1, " ".join(shared[5:35]).upper()), (10, " ".join(shared[:12])), (2, "w1"), (3, ""), (4, None), (5, "W4, W5"), (6, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = fm_decontamination.decontaminate(frame(spark, texts), bench, block=block, shard_bytes=3000)
    assert by_id(df, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == contamination(texts, items, 10)
    for row in df.collect():
        left = WORD.findall((row.kept or "").encode())
        assert len(left) == row.n_words - row.n_hit if row.n_hit else row.kept == row.text
    none = fm_decontamination.decontaminate(frame(spark, texts), bench.limit(0))
    assert {r.n_hit for r in none.collect()} == {0}
    assert fm_decontamination.decontaminate(frame(spark, []), bench).count() == 0


def test_fm_index_parts():
    rng = np.random.default_rng(1)
    for text in ([], [0], [1, 1, 1, 1, 1, 1, 1], list(rng.integers(0, 3, 200)), [0, 2, 2, 0, 2, 2, 0, 2, 2]):
        text = np.array(text, np.int64)
        order = fm_decontamination.suffix_array(text).tolist()
        assert order == sorted(range(len(text)), key=lambda k: text[k:].tolist())
        if len(text):
            index = fm_decontamination.FmIndex(text, 3)
            low, high = index.search(np.array([[2, 1], [1, 1], [0, 2]]), np.array([2, 2, 1]))
            for pattern, a, b in zip(([2, 1], [1, 1], [2]), low, high, strict=True):
                want = [k for k in range(len(text)) if text[k : k + len(pattern)].tolist() == pattern]
                assert sorted(index.locate(np.arange(a, b))) == want
    assert fm_decontamination.merge_spans([[5, 7], [1, 3], [3, 4], [6, 9]]) == [[1, 4], [5, 9]]


def test_best_fit_packing(spark):
    from tokenizers import Tokenizer

    texts, _ = corpus(9)
    texts += ["a  b   c\n\n d 　\xa0 e\x1cf ", "don't 'twas they'll. x<|endoftext|> y", " lead", "tail  ", "\n"]
    tokenizer, seen, bins = Tokenizer.from_file(tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in best_fit_packing.pack(frame(spark, texts), tokenizer_path(), capacity=256).collect():
        seen[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(seen) == set(range(len(texts)))
    for i, rows in seen.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(rows, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes())) and (k == 0 or r.length == 256)
            at += r.length
        assert at == len(ids)
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
    assert best_fit_packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_plan_of_bins():
    rng = random.Random(2)
    for _ in range(50):
        histogram = {rng.randint(1, 90): rng.randint(1, 400) for _ in range(30)}
        plan, count = best_fit_packing.plan_bins(histogram, 90)
        placed, filled = defaultdict(int), defaultdict(list)
        for length, first, last, low, offset in plan:
            assert placed[length] == first
            placed[length] = last
            for k in range(low, low + last - first):
                filled[k].append((offset, length))
        assert placed == histogram and sorted(filled) == list(range(count))
        for items in filled.values():
            assert sum(3 * n > 90 for _, n in items) <= 2
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(items), sorted(items)[1:], strict=False)) and sum(n for _, n in items) <= 90
        assert count <= 1.12 * math.ceil(sum(k * v for k, v in histogram.items()) / 90) + sum(v for k, v in histogram.items() if k > 45)


PAGES = "page_id long, url string, html string, host string, rule int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], PAGES).repartition(3)


def test_warc(spark):
    html = ["<p>a</p>", "\r\n\r\nWARC/1.1\r\n\r\n", "", None, "<p>a</p>", "é" * 5000, "<p>a</p>", ""]
    rows = [(i, f"http://b.a.org/{i % 3}#x" if i else None, h) for i, h in enumerate(html)]
    got = warc_index.archive_and_index(pages(spark, rows)).collect()
    for r in got:
        body = (html[r.page_id] or "").encode()
        first = min(i for i, h in enumerate(html) if (h or "").encode() == body)
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first == r.page_id else "revisit", None if first == r.page_id else first)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want
    order = [(r.url_key, r.timestamp, r.page_id) for r in got]
    assert len(got) == len(html) and order == sorted(order)
    assert warc_index.archive_and_index(pages(spark, [])).count() == 0


def test_loser_tree():
    rng = random.Random(4)
    for k in range(12):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc_index.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_redirects(spark):
    canonical = '<head><LINK href="{}" rel=canonical></head>'
    rows = [
        (1, "HTTP://A.Example.NET/en/x?q", ""), (2, "http://z.net", None), (3, "http://z.net/", ""), (4, "nothing", ""), (5, None, "<p>"),
        (6, "http://m.example.com/fr/1#top", canonical.format("/de/1")), (7, "http://free.com/a/b", canonical.format("c?x=1&amp;y=2")),
        (8, "http://free.com/a/c?x=1&y=2", '<meta http-equiv="Refresh" content="0; url=http://bad.net/q">'),
        (9, "http://open.com/1", canonical.format("http://bad.net/r")), (10, "http://open.com/2", canonical.format("http://example.net/en/9")),
        (11, "http://open.com/3", canonical.format("http://bad.net/r")), (12, "http://from.com/", ""), (13, "http://notexample.com/de/", ""),
    ]
    moved = spark.createDataFrame([("http://from.com/", "http://open.com/2"), ("http://open.com/3#f", "http://open.com/2"), (None, "x")], "src string, dst string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in redirect_blocks.judge(pages(spark, rows), rules, moved).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("z.net", "", None, "allow") and got[3] == ("z.net", "/", "net/", "block")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6][2:] == (None, "block") and got[7][3] == got[8][3] == "block"
    assert {got[k][3] for k in (9, 10, 11, 12)} == {"allow"} and got[13][2] is None and len(got) == len(rows)
    plain = {r.page_id: r.verdict for r in redirect_blocks.judge(pages(spark, rows), rules).collect()}
    assert plain[9] == plain[11] == "block" and plain[10] == plain[12] == "allow"
    assert redirect_blocks.judge(pages(spark, []), rules).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 240)] + [(None, 1), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = start
                todo += near[x]
    assert got == want


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site <b>name</b></header><nav><ul><li><a href=x>One</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>First   long paragraph with
many words in it.<p>Short.</p><form><input><p>Sign up</p></form><script>var t="</p>";</script><p>Third&nbsp;one <a href=y>linked</a> text, rather long as well.</p>
<div class="comments"><p>First! A reader wrote a very long comment here, longer than all.</p></div></article><aside>Side</aside><footer>&copy; us</footer>"""


def test_text_density(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>only"), (5, "u", "<nav>menu</nav>"), (6, "u", "<body>" + "<p>word " * 3000)]
    got = {r.page_id: (r.text, r.n_chars) for r in text_density.extract(pages(spark, rows)).collect()}
    want = "A & B\nFirst long paragraph with many words in it.\nShort.\nThird one linked text, rather long as well."
    assert got[1] == (want, len(want)) and got[2] == got[3] == got[5] == ("", 0) and got[None] == ("only", 4) and got[6][0].count("word") == 3000
    assert text_density.extract(pages(spark, [])).count() == 0


LONG = "A paragraph of the text with quite a number of words, so that it is dense. " * 4
LIST = "".join(f'<li><a href="/{k}">Menu entry {k}</a></li>' for k in range(6))
ITEMS = "".join(f"<li>Item {k}</li>" for k in range(6))


def test_text_density_without_lists():
    got = lambda html: [" ".join(line.split()) for line in text_density.main_text(html).splitlines()]
    long = LONG.strip()
    for inner in (f"<div><ul>{LIST}</ul></div>", f"<ul>{LIST}</ul>", f"<div>{ITEMS}</div>", '<p><a href="/a">One</a> | <a href="/b">Two</a> | <a href="/c">Three</a></p>'):
        for wrap in ("article", "div"):  # sparse blocks inside the text
            assert got(f"<body><{wrap}><h1>Title</h1><p>{LONG}</p><p>Short.</p>{inner}<p>{LONG}</p><p>End.</p></{wrap}></body>") == ["Title", long, "Short.", long, "End."]
    # No article, no nav: menus in plain divs; two content blocks with a short one between.
    page = f"<body><div><ul>{LIST}</ul></div><div><h1>Title</h1><p>{LONG}</p></div><div><p>Short.</p></div><div><p>{LONG}</p></div><div>{ITEMS}</div></body>"
    assert got(page) == ["Title", long, "Short.", long]
    # Two articles of one page.
    assert got(f"<body><article><p>{LONG}</p></article><article><p>{LONG}{LONG}</p></article></body>") == [long, f"{long} {long}"]
    # Wrappers of an article and parts of tokens do not leave text out; whole tokens do.
    for wrap in ('<div class="header">', "<form>", "<aside>", '<div role="dialog">'):
        assert got(f"<body>{wrap}<article><p>{LONG}</p></article></{wrap[1:].split()[0].strip('>')}></body>") == [long]
    assert got(f'<body><div class="share-price form-factor" id="comment-free"><p>{LONG}</p></div></body>') == [long]
    assert got(f'<body><article><p>{LONG}</p><div class="x Comments"><p>{LONG}</p><article><p>{LONG}</p></article></div></article></body>') == [long]
    assert got(f"<body><ul>{LIST}</ul></body>") == []


def test_language(spark):
    rng = random.Random(8)
    stock = {"aa": ["kala", "miru", "tosa", "neko"], "bb": ["straf", "grund", "zwerg", "pflug"]}
    rows = [(i, " ".join(rng.choices(stock[lang], k=9)), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_backoff.fit(docs.where(~language_backoff.held_out(F.col("doc_id"))))
    probe = [(1, "kala neko"), (2, "GRUND!"), (3, "zwergpflug"), (4, "mirukala"), (5, ""), (6, "12 ½ ..."), (7, None), (8, "ü")]
    odd = spark.createDataFrame([(*p, "clash", 1.0) for p in probe], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_backoff.identify(odd, model).collect()}
    assert [got[k][0] for k in range(1, 8)] == ["aa", "bb", "bb", "aa", "und", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())
    empty = language_backoff.fit(docs.limit(0))
    assert {r.lang_pred for r in language_backoff.identify(odd, empty).collect()} == {"und"}
    held = {r.doc_id: r.h for r in docs.select("doc_id", language_backoff.held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in held}


def test_toxicity(spark):
    rng = random.Random(9)
    plain = [rng.choice("bcdfglmn") + rng.choice("aeiou") + rng.choice("prst") + rng.choice("aeiou") + rng.choice("nl") for _ in range(300)]
    rows = []
    for i in range(400):
        own = rng.choices(plain, k=60)
        if i % 4 == 0:
            for k in (5, 25, 45):
                own[k] = rng.choice(["worthlessness", "disgustingly", "idiotically"])
        rows.append((i, " ".join(own), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = compression_toxicity.fit(docs.where(~compression_toxicity.held_out(F.col("doc_id"))))
    got = compression_toxicity.classify(docs, model).collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    odd = spark.createDataFrame([(1, None, "clash"), (2, "", "clash"), (3, "w" * 100_000, "clash")], "doc_id long, text string, score string")
    assert {r.predicted for r in compression_toxicity.classify(odd, model).collect()} == {0}
    assert {r.score for r in compression_toxicity.classify(odd, compression_toxicity.fit(docs.limit(0))).collect()} == {0.0}


def test_toxicity_of_rare_words(spark):
    """Each marked word is in few toxic texts: none has the support of a marked run."""
    rng = random.Random(10)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    plain, marked = [word(5, "abcdefgh") for _ in range(200)], [word(14, "qrstuvwxyz") for _ in range(40)]
    rows = []
    for i in range(800):
        own = rng.choices(plain, k=40)
        if i % 8 == 0:
            own[10:12] = [marked[i // 8 % 40]] * 2
        rows.append((i, " ".join(own), int(i % 8 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    got = compression_toxicity.classify(docs, compression_toxicity.fit(docs.where(~compression_toxicity.held_out(F.col("doc_id"))))).collect()
    mean = {y: np.mean([r.score for r in got if r.toxic == y and r.doc_id in held]) for y in (0, 1)}
    assert mean[1] > mean[0] + 0.2


def test_sample_of_distinct_texts(spark):
    """Copies neither take places of the sample nor count as evidence."""
    texts = [(f"text {k}", k % 2) for k in range(400)]
    copies = spark.createDataFrame(texts + [(f"text {k}", 1) for k in (1, 3, 5, 7, 9)] * 3000, "text string, toxic int")
    once = spark.createDataFrame(texts, "text string, toxic int")
    for sample in (50, 1000):
        (n, drawn), (m, want) = (distinct_sample(df, "toxic", sample, seed=11, bound=2) for df in (copies, once))
        assert n == m == {0: 200, 1: 200} and sorted(drawn.collect()) == sorted(want.collect())
        assert drawn.count() == 400 if sample == 1000 else 60 < drawn.count() < 140
    # The models do not depend on copies.
    rows = [(f"{a} kala {b}", y) for k in range(60) for y in (0, 1) for a, b in [(f"wa{k % 7}x" + "q" * y, f"mi{k}" + "zz" * y)]]
    for fit, name, kind in ((compression_toxicity.fit, "toxic", "int"), (language_backoff.fit, "lang", "string")):
        fits = [fit(spark.createDataFrame(own, f"text string, {name} {kind}").repartition(3), sample=20) for own in ([(t, y if kind == "int" else str(y)) for t, y in more] for more in (rows, rows + rows[1::2][:4] * 500))]
        assert set(fits[0]) == set(fits[1])
        for key in fits[0]:
            if key == "weights":
                assert np.allclose(fits[0][key], fits[1][key])
            elif key == "tables":
                assert all(a == b and np.array_equal(x, y) for (a, x), (b, y) in zip(fits[0][key], fits[1][key], strict=True))
            else:
                assert fits[0][key] == fits[1][key]


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    rows = [(i, (centre[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1500)] + [(k, [1.0] * 16) for k in range(1500, 1560)]
    bad = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0, None]), (9004, []), (9005, [float("inf")] * 16), (None, [1.0] * 16), (9010, [1.0, 2.0]), (40, rows[40][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in pruned_graph.nearest(table, table.where("vec_id % 20 = 0"), top=10, shard_rows=400).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, x, hits = np.array([i for i, _ in rows]), np.array([v for _, v in rows]), []
    for k in np.flatnonzero(ids % 20 == 0):
        own = sorted(got[int(ids[k])])
        score = x @ x[k]
        score[k] = -np.inf
        assert [r for r, *_ in own] == list(range(1, 11)) and all(abs(score[v] - s) < 1e-9 for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        hits.append(len({v for _, v, _ in own} & set(ids[np.lexsort((ids, -score))[:10]])) / 10)
    assert np.mean(hits) >= 0.9 and set(got) == set(ids[ids % 20 == 0].tolist())
    few = pruned_graph.nearest(table.where("vec_id < 4"), table.where("vec_id = 1"), top=20).collect()
    assert sorted(r.vec_id for r in few) == [0, 2, 3]
    assert pruned_graph.nearest(table.limit(0), table.limit(0)).count() == 0
