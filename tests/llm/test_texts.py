"""HTML text, language, fingerprints, packing, decontamination, passages, lines."""

import hashlib
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provspark.llm import decontamination as D
from provspark.llm import fingerprint as FP
from provspark.llm import html_text as H
from provspark.llm import language as L
from provspark.llm import line_dedup as LD
from provspark.llm import lm_score as LM
from provspark.llm import packing as P
from provspark.llm import suffix_dedup as S
from provspark.llm.queries import tokenizer_path

from .fixtures import SPACED, UPPER, corpus, empty, frame, words

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><aside>Side</aside>
<article><h1>Head &amp; more</h1><p><b>One  two<br>three<p>Four&nbsp;&#233;<div class="ad">Buy</div><form>f<input></form></p>
<ul><li>a<li>b</ul></article><div id="comments"><p>Nice!</p></div><footer>&copy; x</footer>"""


def test_article_text():
    text, path = H.extract(H.parse(PAGE), [])
    assert text.split("\n\n") == ["Head & more", "One two three", "Four é", "a", "b"]
    assert path == ">html>body>article"


LABELLED = [
    # (html, blocks of the article)
    ("<div class='content no-sidebar'><h1>T</h1><p>Main text here.</p></div><footer>f</footer>", ["T", "Main text here."]),
    ("<div class='site-main has-sidebar'><p>Main text here.</p></div><div class='sidebar'>side</div>", ["Main text here."]),
    ("<div class='page nav-open'><p>Main text.</p></div><div class=site-footer>foot</div>", ["Main text."]),
    ("<div class='wrapper header-fixed'><article><p>Main</p></article></div>", ["Main"]),
    ("<div class='content-sidebar-wrap'><article><h1>H</h1><p>Main</p></article><div class=left-sidebar>s</div></div>", ["H", "Main"]),
    ("<article><p>Before.</p><figure><img src=x><figcaption>A caption</figcaption></figure><p>With <math><mi>x</mi><mo>=</mo><mn>1</mn></math> inside.</p></article>", ["Before.", "A caption", "With x=1 inside."]),
    ("<article><h1>Head</h1><p>Lead.</p><div class='story-body'><p>" + "Long story text. " * 30 + "</p></div></article>", ["Head", "Lead.", ("Long story text. " * 30).strip()]),
    ("<div id=c><div class=a><p>First part of it.</p></div><div class=b><p>Second part.</p></div></div><div class=menu><a href=x>l</a></div>", ["First part of it.", "Second part."]),
    ("<article><p>Short.</p></article><div id='comments'><article class='comment'><p>" + "A long reader comment. " * 40 + "</p></article></div>", ["Short."]),
    ("<div class='cookie-notice'>We use cookies</div><main><p>Text &lt;b&gt; &amp;amp; &eacute;&#x41;</p><div class='ad-slot'>Buy</div><div class=related><article><p>Other</p></article></div></main>", ["Text <b> &amp; éA"]),
    ("<nav>n</nav><p>Only paragraphs here.</p><p>And a second one.</p><div class=x><p>Third in a div.</p></div><form>f</form>", ["Only paragraphs here.", "And a second one.", "Third in a div."]),
    ("<blockquote>" + "A quote that is long. " * 20 + "</blockquote><p>x</p>", None),
]


@pytest.mark.parametrize("source,blocks", LABELLED)
def test_labelled_pages(source, blocks):
    page = H.parse(f"<html><body>{source}</body></html>")
    text, _ = H.extract(page, [p for p, _ in H.votes(page)][:1])
    if blocks is not None:
        assert text.split("\n\n") == blocks
        assert H.extract(page, [])[0] == text
    else:
        assert "A quote that is long." in text


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "</span>" * 100_000, "<p><td>" + "<b>" * 100_000 + "<hr>" * 100_000, "<b>x" * 100_000 + "</i>" * 100_000, "<div class='ad'>" * 50_000 + "x" + "</div>" * 50_000, "<p>a " * 200_000, "&" * 1_000_000, "<" * 300_000, "<a " * 100_000])
def test_odd_markup_takes_linear_time(source):
    began = time.perf_counter()
    page = H.parse(source)
    H.votes(page)
    H.extract(page, [])
    assert time.perf_counter() - began < 15


def test_pages(spark):
    plain = "<html><body><div class='post-12'><p>" + "long text here. " * 20 + "</p></div><div class='menu'>x</div>"
    rows = [(1, "http://H.example/a", PAGE, 1), (2, None, None, 2), (3, "no url", "", 3), (4, "http://h.example:80/b?c", PAGE, 4), (4, "http://h.example:80/b?c", PAGE, 4), (5, "https://p.example/1", plain, 0), (6, "https://p.example/2", plain.replace("12", "77"), 0), (7, "https://p.example/2", "<div>" * 3000 + "deep" + "</x>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {(r["page_id"], r["url"]): r for r in H.extract_pages(df).collect()}
    assert H.extract_pages(df).count() == 8
    assert got[2, None]["text"] == "" and got[3, "no url"]["n_chars"] == 0
    assert got[1, "http://H.example/a"]["text"].startswith("Head & more")
    assert got[5, "https://p.example/1"]["path"] == got[6, "https://p.example/2"]["path"] == ">html>body>div.post-#"
    assert got[7, "https://p.example/2"]["text"] == "deep"
    assert H.extract_pages(df.limit(0)).count() == 0


def _languages(n):
    rng = random.Random(n)
    alphabets = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "oßäüprst"}
    return [(i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 40))), lang) for i in range(n) for lang in [rng.choice(list(alphabets))]]


def test_language_held_out_accuracy(spark):
    rows = [(*r, 1) for r in _languages(400)] + [(1000, None, "aa", 0), (1001, "12 !?", "bb", 0), (1002, "abc bad fed", None, 0), (1003, "これは日本語の文章です", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in L.language_query(df).collect()}
    assert len(got) == 404
    held = [r for r in rows[:400] if got[r[0]]["held_out"]]
    assert held and all(got[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert not any(got[r[0]]["rejected"] for r in rows[:400])
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["score"] == 0
    assert got[1002]["lang_pred"] in ("aa", "bb", "cc") and got[1003]["rejected"]


def test_language_learns_from_long_texts_and_all_languages(spark):
    """A language of long texts only is learned, and small languages beside a huge one."""
    rows = [(i, t, lang) for i, t, lang in _languages(300) if lang != "cc"]
    rows += [(1000 + i, "ß ö ä ü ß " * 2_000, "cc") for i in range(12)]
    rows += [(2000 + i, "zzyy wwvv xxyy " * 3, "tiny") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df, L.Settings(sample_rows=80))
    assert model.languages == ["aa", "bb", "cc", "tiny"]
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(df, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.97 * len(rows)
    again = L.fit(df.repartition(7), L.Settings(sample_rows=80))
    assert np.array_equal(model.logits, again.logits)


def test_language_with_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in L.language_query(df).collect()} == {"und"}
    assert L.language_query(empty(spark)).count() == 0


def canon(text):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    form = nfkc(nfkc(text).casefold())
    return re.sub("[\t-\r \x85\xa0  -     　]+", " ", form).strip(" ")


def test_fingerprints_match_brute_force(spark):
    rows = corpus(700, 5) + [(50_000, "Ａｂｃ  STRASSE"), (50_001, "abc straße"), (50_002, "abc straße ")]
    got = {r["doc_id"]: r for r in FP.fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    by_form = {}
    for (i, t), (j, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited)), i
        assert r["near_next"] == float(canon(t) == canon(u)) and r["near_edited"] == float(canon(t) == canon(edited))
        assert by_form.setdefault(canon(t), r["fingerprint"]) == r["fingerprint"]
        assert by_form.setdefault(canon(edited), r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert len(set(by_form.values())) == len(by_form)


def test_fingerprint_edges(spark):
    assert FP.fingerprints(empty(spark)).count() == 0
    rows = [(7, "abcd"), (7, "abcd"), (None, "xy"), (1, None)]
    got = FP.fingerprints(frame(spark, rows)).collect()
    assert len(got) == 4 and {r["near_next"] for r in got if r["n_chars"] == 4} == {0.0, 1.0}
    alone = FP.fingerprints(frame(spark, [(1, "abcd")])).first()
    assert alone["edited_sha256"] == sha("abab") and alone["near_next"] == 1.0


def test_unequal_texts_in_one_bucket(spark):
    forms = spark.createDataFrame([("h", "a"), ("h", "b"), ("h", "a"), ("g", "c"), ("g", "c")], "fp string, form string")
    assert {(r["form"], r["suffix"]) for r in FP.distinct_suffixes(forms).collect()} == {("a", "-0"), ("b", "-1")}


def test_encoder_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = [t_ or "" for _, t_ in corpus()] + ["it's  we'll\n\n x  ", "퟿ 𝒳 👩‍🚀"]
    assert P.encoder(tokenizer_path())(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_a_partition(spark):
    rows = corpus(300, 9) + [(7, "same"), (7, "same")]
    got = P.pack(frame(spark, rows), tokenizer_path()).toPandas()
    ids = [np.array([*x, 2], "<u4") for x in P.encoder(tokenizer_path())([t or "" for _, t in rows])]
    expected = Counter((i, n, s, k, zlib.crc32(x[s : s + k])) for (i, _), x in zip(rows, ids) for n, (s, k) in enumerate(P.piece_bounds(len(x))))
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == expected
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.length.sum() <= 1024 and (g.offset == g.length.cumsum() - g.length).all()
    least = math.ceil(sum(map(len, ids)) / 1024)
    assert got.sequence_id.nunique() <= least + 2
    assert P.pack(empty(spark), tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 1_000_000, "\n \t" * 200_000, "\xa0" * 100_000, "1" * 300_000])
def test_encoder_takes_long_runs(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    assert P.encoder(tokenizer_path())([text]) == [t.encode(text, add_special_tokens=False).ids]


@pytest.mark.parametrize("seed", range(4))
def test_genetic_search_beats_best_fit(seed):
    """Per island: fewer bins than best-fit decreasing where that isn't optimal, and never more."""
    rng = np.random.default_rng(seed)
    hard = rng.integers(200, 500, 300).tolist()
    triplets = [x for _ in range(60) for a in [int(rng.integers(380, 490))] for b in [int(rng.integers(250, (1000 - a) // 2))] for x in (a, b, 1000 - a - b)]
    easy = rng.integers(1, 900, 700).tolist()
    for sizes, gain in ((hard, 2), (triplets, 4), (easy, 0)):
        seeded = P.Packing(sizes, 1000)
        seeded.best_fit(list(range(len(sizes))))
        best = P.evolve(sizes, [], 1000, seed)
        assert sorted(i for b in best.bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) + f == 1000 and f >= 0 for b, f in zip(best.bins, best.free))
        assert len(best.bins) <= len(seeded.bins) - gain and best.fitness() >= seeded.fitness()


def test_islands_migrate(spark):
    rows = corpus(300, 11)
    got = P.pack(frame(spark, rows), tokenizer_path(), island_pieces=20).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 1024).all() and got.sequence_id.nunique() <= 1.03 * got.length.sum() / 1024 + 3


def test_piece_bounds():
    assert P.piece_bounds(1024) == [(0, 1024)] and P.piece_bounds(1) == [(0, 1)]
    assert P.piece_bounds(2050) == [(0, 2), (2, 1024), (1026, 1024)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=6))
def test_fm_index(symbols, patterns):
    index = D.FMIndex(np.array(symbols), 5, sample=3)
    low, high = index.search(np.array(patterns))
    for p, a, b in zip(patterns, low, high):
        expected = [i for i in range(len(symbols) - 2) if symbols[i : i + 3] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def brute_contamination(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(w) for w in windows}
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[key]
        yield (i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))


def _contaminated():
    rows = corpus(80, 13)
    texts = [t for _, t in rows if t and len(words(t)) > 40]
    items = [(1, " ".join(words(texts[0])[3:20])), (2, " ".join(words(texts[5])[:12]).upper() + "!"), (10, "changed"), (11, None), (12, ""), (13, texts[9])]
    return rows, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 64])
def test_contamination_matches_brute_force(spark, block_bytes):
    rows, items = _contaminated()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    found = D.find_contamination(frame(spark, rows), bench, block_bytes=block_bytes).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), sha(",".join(r["items"])), r["n_hit"] > 0) for r in found)
    assert got == sorted(brute_contamination(rows, items))
    texts = dict(rows)
    for r in found:  # what the spans cover is what was hit
        covered = sum(len(words(texts[r["doc_id"]][s["start"] : s["end"]])) for s in r["spans"])
        assert covered == r["n_hit"]


def test_words_of_equal_hash_are_compared():
    data = np.frombuffer(b"one two three four five", np.uint8)
    tests = D.test_windows([(1, "Two three four")], 3)
    words = D.K.find_words(data, np.array([0, len(data)]), D.K.ALNUM)
    start, length, window = D.search_slice(words, tests)
    assert start.tolist() == [1] and D.equal_words(words, data, tests, start, length).all()
    changed = data.copy()
    changed[9] = ord("x")  # another letter under the same hash
    assert not D.equal_words(words, changed, tests, start, length).any()


def test_contamination_edges(spark):
    rows, _ = _contaminated()
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination_digest(frame(spark, rows), none).where("contaminated").count() == 0
    assert D.contamination_digest(empty(spark), none).count() == 0
    df = spark.createDataFrame([("one two three four",)], "text string")
    cut = D.remove_spans(df["text"], D.F.expr("array(struct(4 as start, 8 as end), struct(14 as start, 18 as end))"))
    assert df.select(cut).first()[0] == "one three "


def brute_passages(rows):
    rows = list({(i, t) for i, t in rows})
    where = defaultdict(set)
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(r)
    out = set()
    for r in rows:
        w = words(r[1])
        hit = [False] * len(w)
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                hit[k : k + 50] = [True] * 50
        k = 0
        while k < len(w):
            if hit[k]:
                end = k
                while end < len(w) and hit[end]:
                    end += 1
                out.add((r[0], k, end))
                k = end
            k += 1
    return out


def test_passages_match_brute_force(spark):
    rows = corpus(120, 17)
    rows += [(10_000 + i, " ".join(["echo"] * 70) + f" tail{i}") for i in range(3)] + [rows[3]]
    got = {tuple(r) for r in S.repeated_passages(frame(spark, rows)).collect()}
    assert got == brute_passages(rows)


def test_passages_edges(spark):
    assert S.repeated_passages(empty(spark)).count() == 0
    same = " ".join(f"w{i}" for i in range(60))
    assert S.repeated_passages(frame(spark, [(1, same), (1, same), (2, None), (3, "")])).count() == 0
    assert {tuple(r) for r in S.repeated_passages(frame(spark, [(1, same), (None, same)])).collect()} == {(1, 0, 60), (None, 0, 60)}


def test_passages_left_of_a_frequent_phrase(spark, monkeypatch):
    """Two documents in 600 share 60 words that end in a phrase which all hold."""
    rng = random.Random(5)
    prose = lambda k: " ".join(f"v{rng.randrange(10**6)}" for _ in range(k))
    phrase = prose(30)
    rows = [(i, f"{prose(30)} {phrase} {prose(30)}") for i in range(600)]
    for a, b in ((7, 411), (90, 91), (200, 599)):
        before = prose(30)
        rows[a], rows[b] = ((i, f"{before} {phrase} {prose(30)}") for i in (a, b))
    expected = brute_passages(rows)
    assert len(expected) == 6
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        assert {tuple(r) for r in S.repeated_passages(frame(spark, rows)).collect()} == expected
        monkeypatch.setattr(S, "LARGE", 100)
        assert {tuple(r) for r in S.repeated_passages(frame(spark, rows)).collect()} == expected
        rows = corpus(120, 17) + [(10_000 + i, " ".join(["echo"] * 170) + f" tail{i}") for i in range(3)]
        assert {tuple(r) for r in S.repeated_passages(frame(spark, rows)).collect()} == brute_passages(rows)
        monkeypatch.setattr(S, "LARGE", 0)
        assert {tuple(r) for r in S.repeated_passages(frame(spark, rows)).collect()} == brute_passages(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(UPPER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i)]
        yield (i, len(lines), len(lines) - len(kept), sha("\n".join(kept)))


def test_lines_match_brute_force(spark):
    rows = corpus(150, 19)
    got = sorted(tuple(r) for r in LD.line_digest(frame(spark, rows)).collect())
    assert got == sorted(brute_lines(rows)) and any(r[2] for r in got)


def test_line_edges(spark):
    assert LD.line_digest(empty(spark)).count() == 0
    line = "a long line of more than twenty"
    rows = [(1, line), (1, line), (2, line), (None, f"{line}\nx"), (3, f"{line}\n{line}")]
    got = sorted((r["n_lines"], r["n_dropped"]) for r in LD.line_digest(frame(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 0), (2, 1)]
    two = [(1, line), (1, line + " "), (2, line)]
    assert all(r["n_dropped"] == 0 for r in LD.line_digest(frame(spark, two)).collect())


def test_scores_match_brute_force(spark):
    rows = corpus(150, 23) + [(5, "twice here"), (5, "twice here")]
    got = defaultdict(list)
    for r in LM.score_documents(frame(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    tokens = lambda t: [*SPACED.findall((t or "").translate(UPPER)), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert any((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(counts[x] > 0 for x in w), n) and abs(r["base_score"] - base) < 1e-6 * max(1, -base) for r in got[i]), i
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for rs in got.values() for r in rs)
    assert LM.score_documents(empty(spark)).count() == 0


def _counts(top, tail_tokens=None, tail_words=None):
    z = np.zeros(LM.TAIL_CLASSES, np.int64)
    tail_tokens, tail_words = (z if x is None else x for x in (tail_tokens, tail_words))
    return LM.Counts(int(sum(top) + tail_tokens.sum()), len(top) + int(tail_words.sum()), np.arange(len(top), dtype=np.uint64) * 7 + 1, np.array(top), tail_tokens, tail_words)


def test_probabilities_are_normalised_and_learned():
    rng = np.random.default_rng(0)
    symbols = np.tile(np.arange(200), 300)  # the next word follows from the last
    offsets, counts = np.array([0, len(symbols)]), _counts([300] * 200)
    w = LM.start_weights(counts)
    last = lambda c: LM.log_probabilities(w, counts, np.concatenate([symbols[:20], [c]]), np.array([0, 21]))[-1]
    assert abs(sum(np.exp(last(c)) for c in range(counts.symbols)) - 1) < 1e-4
    before = LM.log_probabilities(w, counts, symbols[:400], np.array([0, 400])).mean()
    trainer, context = LM.Trainer(w, counts), LM.contexts(symbols, offsets, counts.symbols)
    for _ in range(8):
        trainer.run(context, symbols, rng)
    assert abs(sum(np.exp(last(c)) for c in range(counts.symbols)) - 1) < 1e-4
    assert LM.log_probabilities(w, counts, symbols[:400], np.array([0, 400])).mean() > before + 1


def test_model_scores_match_brute_force(spark, monkeypatch):
    """score, from the learned weights, word by word with plain softmaxes; the same for any partitioning."""
    rows = corpus(120, 31)
    df = frame(spark, rows)
    blocks = LM.make_blocks(df)
    counts = LM.gather_counts(LM.count_words(blocks))
    weights = LM.train(blocks, counts, worker_tokens=900)
    monkeypatch.setattr(LM, "train", lambda b, c: weights)
    got = {r["doc_id"]: r["score"] for r in LM.score_documents(df).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*SPACED.findall((t or "").translate(UPPER)), None]
    known = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    top = [w for w, n in known.items() if n >= LM.LEAST_COUNT]
    assert counts.size == len(top) and sorted(counts.top_counts.tolist()) == sorted(known[w] for w in top)

    def symbol_of(word):  # hashes and tail classes by the kernel, one word at a time
        if word is None:
            hashes, tail = np.array([LM.END]), np.array([0])
        else:
            found = LM._block(pa.record_batch({"text": pa.array([word]), "held_out": pa.array([False])}))
            n = int(np.flatnonzero(found[0] != LM.END)[0])
            hashes, tail = found[0][n : n + 1], found[1][n : n + 1]
        return int(LM.symbols_of(hashes, tail, counts)[0])

    symbol = {w: symbol_of(w) for i, t in rows for w in tokens(t)}
    in_tail = Counter(symbol[w] for w in known if symbol[w] >= counts.size)
    tail_tokens = Counter()
    for w, n in known.items():
        tail_tokens[symbol[w]] += n
    for i, t in rows[::4] + rows[-14:]:
        before, total = [counts.symbols] * 4, 0.0
        for w in tokens(t)[:60] if len(tokens(t)) > 400 else tokens(t):
            s = symbol[w]
            h = sum(weights.inputs[before[j]] @ weights.maps[j] for j in range(4))
            z = weights.classes[:, :-1] @ h + weights.classes[:, -1]
            c = s // LM.MEMBERS if s < counts.size else s - counts.size + counts.word_classes
            total += z[c] - math.log(sum(math.exp(x) for x in z))
            if s < counts.size:
                own = weights.words[c * LM.MEMBERS : (c + 1) * LM.MEMBERS]
                z = own[:, :-1] @ h + own[:, -1]
                total += z[s % LM.MEMBERS] - math.log(sum(math.exp(x) for x in z))
            else:
                total += math.log((known[w] + 1) / (tail_tokens[s] + in_tail[s] + 1))
            before = [s, *before[:3]]
        if len(tokens(t)) <= 400:
            assert abs(got[i] - total / math.log(10)) < 1e-4 * max(1, -got[i]), i


def test_weights_do_not_depend_on_the_partitioning(spark):
    df = frame(spark, corpus(120, 37))
    out = []
    for n in (1, 5):
        blocks = LM.make_blocks(df.repartition(n))
        counts = LM.gather_counts(LM.count_words(blocks))
        out.append(LM.train(blocks, counts, worker_tokens=700))
    assert all(np.array_equal(x, y) for x, y in zip(out[0].parts, out[1].parts))


def test_text_bytes_of_slices():
    from provspark.llm.shared import slices, text_bytes

    a = pa.array(["ab", None, "", "é", "long text"])
    data, offsets = text_bytes(a.slice(1, 3))
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 0, 2]
    batch = pa.record_batch({"text": a})
    assert [b.num_rows for b in slices(batch, "text", 3)] == [3, 1, 1]


def test_scoring_holds_one_slice_of_a_block(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    tail = np.full(LM.TAIL_CLASSES, 5, np.int64)
    counts = LM.Counts(10_000, 400, np.arange(300, dtype=np.uint64) * 7 + 1, np.arange(300, 0, -1) + 9, tail, tail // 2)
    weights = LM.start_weights(counts)
    symbols = rng.integers(0, counts.symbols, 1 << 20).astype(np.uint16)
    offsets = np.concatenate([[0], np.sort(rng.choice(np.arange(1, len(symbols)), 3000, replace=False)), [len(symbols)]])
    tracemalloc.start()
    LM.log_probabilities(weights, counts, symbols, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20  # 8 MB are the result's; contexts of the whole block alone took 32 MB and as much to make them
    few, cuts = symbols[:900], np.array([0, 1, 2, 250, 251, 900])
    whole = LM.log_probabilities(weights, counts, few, cuts)
    assert (LM.contexts(few, cuts, 9999, 248, 256) == LM.contexts(few, cuts, 9999)[248:256]).all()
    monkeypatch.setattr(LM, "SCORED", 7)
    assert LM.log_probabilities(weights, counts, few, cuts) == pytest.approx(whole, abs=1e-5)


def test_distinct_words_and_softmax_sums():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5000):
        values = rng.integers(0, 700, n).astype(np.uint64) << np.uint64(50)
        distinct, at, inverse = LM._distinct(values)
        assert (distinct == np.unique(values)).all() and (values[at] == distinct).all() and (distinct[inverse] == values).all()
    h, outputs, target = rng.normal(size=(700, 17)).astype(np.float32), rng.normal(size=(90, 17)).astype(np.float32), rng.integers(0, 90, 700)
    z = h.astype(np.float64) @ outputs.T
    exact = z[np.arange(700), target] - np.log(np.exp(z).sum(axis=1))
    for bounded in (True, False):
        for rows in (0, 1, 256, 700):
            assert LM._log_sums(h[:rows], outputs, target[:rows], bounded) == pytest.approx(exact[:rows], abs=1e-4)
    far = LM._log_sums(h * 100, outputs, target, False)
    assert np.isfinite(far).all() and (far <= 0).all()
