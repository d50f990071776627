"""BPE, toxicity, language identification and HTML extraction."""

import hashlib
import html
import re
import time
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, html_extract, language_id, toxicity

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "It's we're I'LL", "ΑΣ Σ ΟΔΟΣ", "İstanbul", "a<|endoftext|>b", "a\x1cb\x1fc", "日本語 ﬁ e\u0301", "a\u00a0b\u3000c", "12 ½", "x" * 300, "zq" * 500, "word " * 20_000, "same", "same"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, score string")


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_the_library(spark, odd, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionAll(odd.select(F.col("doc_id") + 10**6, "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.digests(docs, bpe.default_vocabulary()).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_classes_equal_the_library_in_all_planes(library):
    """Every code point but ideographs and syllables in bulk, alone, between letters, after a digit, and with marks around it."""
    codec = bpe.Codec(open(bpe.default_vocabulary(), "rb").read())
    bulk = ((0x4E00, 0x9FFE), (0xAC00, 0xD7A2), (0xD800, 0xDFFF), (0x17000, 0x187F6), (0x20000, 0x3134F), (0xE0200, 0x10FFFF))
    points = [i for i in range(0x80, 0x110000) if not any(a <= i <= b for a, b in bulk)]
    for at in range(0, len(points), 4000):
        texts = [f"a{c}b 1{c}2 {c} e{c}\u0301\u0327" for c in map(chr, points[at : at + 4000 : 1 if at < 60_000 else 5])]
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert codec.encode(text) == want.ids, hex(ord(text[1]))


def test_bpe_cuts_only_where_no_token_reaches():
    codec = bpe.Codec(open(bpe.default_vocabulary(), "rb").read())
    for word in ("hello", "überraschung", "qzxv", "naïveté", "zq" * 40):
        symbols = [codec.symbols[b] for b in word.encode()]
        symbols[-1] += codec.end
        whole, parts = codec.merge(tuple(symbols)), [codec.merge(f) for f in codec.fragments(word)]
        assert list(whole) == [i for p in parts for i in p]
        assert codec._merge_long(tuple(symbols)) == whole
    assert len(codec.fragments("qzxv")) > 1


def test_bpe_keeps_columns_and_empty_tables(spark, odd):
    out = bpe.encode_decode(odd.withColumn("ids", F.lit("clash")), bpe.default_vocabulary())
    assert out.columns == ["doc_id", "text", "score", "ids", "decoded"] and out.count() == len(ODD)
    assert bpe.encode_decode(odd.limit(0), bpe.default_vocabulary()).count() == 0


def test_machine_learns_a_pair_that_weights_cannot():
    rng = np.random.default_rng(0)
    a, b = toxicity.slots_of("grumbles")[0], toxicity.slots_of("neighbours")[0]
    rows, labels = [], []
    for i in range(1200):
        has = (i % 2, i // 2 % 2)
        rows.append(np.unique([*rng.integers(1000, 1030, 5), *([a] if has[0] else []), *([b] if has[1] else [])]))
        labels.append(float(all(has)))
    m = toxicity.train(rows, np.array(labels), epochs=40)
    z = lambda *s: m.logits(np.array(sorted(s)), np.array([len(s)]))[0]
    assert z(a, b) > 0 > max(z(a), z(b))


def test_logits_equal_a_loop_over_pairs_and_no_text_depends_on_its_neighbours():
    rng = np.random.default_rng(3)
    m = toxicity.Machine(0.3, rng.normal(size=1 << toxicity.BITS).astype(np.float32), rng.normal(size=(1 << toxicity.BITS, toxicity.FACTORS)).astype(np.float32))
    texts = ["you absolute fool", "", None, "a b c d e f g", "fool fool Fool", "x " * 3000]
    for t, got in zip(texts, m.scores(texts)):
        s = toxicity.slots_of(t)
        z = m.bias + sum(float(m.w[i]) for i in s) + sum(float(np.dot(m.v[i].astype(float), m.v[j].astype(float))) for k, i in enumerate(s) for j in s[k + 1 :])
        assert abs(got - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
        assert got == m.scores([t])[0] == m.scores([texts[3], t])[1]


def test_training_lowers_the_loss_along_its_gradient():
    """One step on two texts: each weight and the bias move against the loss's slope, taken by differences."""
    a, b = toxicity.slots_of("grumbles")[:2], toxicity.slots_of("kindness")[:2]
    rows, labels = [np.array(sorted(a))] * 6 + [np.array(sorted(b))] * 6, np.array([1.0] * 6 + [0.0] * 6)
    m = toxicity.train(rows, labels, epochs=3)

    def loss(machine):
        z = machine.logits(np.concatenate(rows), np.cumsum([len(r) for r in rows]))
        return np.mean(np.log1p(np.exp(z)) - labels * z)

    for slot, sign in ((a[0], -1), (b[0], 1)):
        w = np.zeros_like(m.w)
        at_zero = toxicity.Machine(0.0, w, np.zeros_like(m.v))
        up = w.copy()
        up[slot] = 1e-3
        slope = (loss(toxicity.Machine(0.0, up, at_zero.v)) - loss(at_zero)) / 1e-3
        assert np.sign(slope) == sign == -np.sign(m.w[slot])


def test_machine_learns_a_rare_insult_from_a_full_sample():
    rng = np.random.default_rng(1)
    n, often, rare = toxicity.SAMPLE, toxicity.slots_of("idiot"), toxicity.slots_of("numpty")
    rows, labels = [], []
    for i in range(n):
        bad = often if i % 10 == 0 else rare if i % 417 == 1 else []
        rows.append(np.unique([*rng.integers(1000, 1400, 30), *bad]).astype(np.int32))
        labels.append(float(bool(bad)))
    assert sum(i % 417 == 1 and i % 10 != 0 for i in range(n)) < n // 400
    m = toxicity.train(rows, np.array(labels))
    z = m.logits(np.concatenate(rows), np.cumsum([len(r) for r in rows]))
    hit = [z[i] > 0 for i in range(n) if i % 417 == 1 and i % 10]
    assert all(hit) and np.mean(z[np.array(labels) == 0] < 0) > 0.99


def test_toxicity_on_held_out_rows(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    docs = [(i, " ".join(words[(i * k) % 6] for k in range(1, 30)) + (" scum idiot" if i % 4 == 0 else "")) for i in range(600)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.unionAll(labels.limit(5)).unionAll(spark.createDataFrame([(1, None, 1)], labels.schema)).write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op1_toxicity(spark, str(tmp_path)).toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = out[out.held_out]
    assert (held.predicted == (held.doc_id % 4 == 0)).all() and ((held.score >= 0.5) == (held.predicted == 1)).all()


def test_toxicity_of_odd_texts_and_without_labels(spark, odd):
    m = toxicity.fit(odd.drop("score"), spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.scored(odd, m).toPandas()
    assert len(out) == len(ODD) and (out.score < 0.5).all()
    assert toxicity.scored(odd.limit(0), m).count() == 0


def test_language_on_held_out_rows(spark):
    out = language_id.op5_language_id(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet"), on="doc_id")
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.93 and out.score.between(0, 1).all()


def test_language_of_odd_texts(spark, odd):
    net = language_id.train(["the cat and the dog", "der hund und die katze"] * 20, ["en", "de"] * 20)
    out = {r.doc_id: r for r in language_id.identified(odd.withColumn("lang_pred", F.lit(1)), net).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2, 10)] == ["und"] * 4 and out[0].score == 0
    assert out[14].lang_pred == out[15].lang_pred and out[13].lang_pred in ("en", "de")
    assert language_id.identified(odd, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.fit(odd.limit(0).withColumn("lang", F.lit("en"))) is None


def test_prediction_equals_plain_loops(spark):
    """Windows, convolution, maxima, softmax and mean, step by step."""
    net = language_id.train(["the cat and the dog", "der hund und die katze"] * 20, ["en", "de"] * 20)
    texts = ["the dog", "die katze " * 40, "ÜBER " * 60, "x"]
    for text, lang, score in zip(texts, *net.predict(texts)):
        data = text.lower().encode()
        total, size = np.zeros(2), 0
        for at in range(0, len(data), language_id.WINDOW):
            part = data[at : at + language_id.WINDOW]
            w = part.ljust(language_id.WINDOW, b"\0")
            h = [max(sum(float(t[j][w[p + j]][f]) for j in range(len(t))) for p in range(len(w) - len(t) + 1)) for t in net.tables for f in range(language_id.FILTERS)]
            z = np.maximum(np.array(h) + net.bias, 0) @ net.out + net.out_bias
            e = np.exp(z - z.max())
            total, size = total + e / e.sum() * len(part), size + len(part)
        assert lang == net.languages[int(total.argmax())] and abs(score - total.max() / size) < 1e-4


def test_language_of_an_empty_table(spark, odd):
    net = language_id.train(["the cat", "der hund"] * 5, ["en", "de"] * 5)
    assert language_id.identified(odd.limit(0), net).count() == 0


def test_maxima_equal_a_plain_convolution():
    net = language_id.train(["abcabc", "xyzxyz"] * 8, ["a", "b"] * 8, epochs=1)
    w, _, _ = language_id.windows(["hello world, this is a text"])
    got, _ = net.pooled(w)
    plain = [max(sum(t[j][w[0, p + j]][f] for j in range(len(t))) for p in range(language_id.WINDOW - len(t) + 1)) for t in net.tables for f in range(language_id.FILTERS)]
    assert np.allclose(got[0], np.array(plain) + net.bias, atol=1e-4)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site</p></div>
<article><header><h1>Title &amp; more</h1></header><p><b>One<br>two</p><p>three
four</p><div class="ad"><p>Buy this now</p></div><ul><li>item</li></ul></article>
<section class="comments"><p>First!</p><p>I disagree with all of this</p></section><form><p>Subscribe to us</p></form><footer>&copy; me</footer></body></html>"""


def test_extraction_of_a_page_with_all_parts(spark):
    w = html_extract.trained_weights()
    assert html_extract.main_text(PAGE, w) == "Title & more\n\nOne two\n\nthree four\n\nitem"


@pytest.mark.parametrize(
    ("odd", "kept"),
    [("<svg/>", ""), ("<math/>", ""), ("<iframe src='x'/>", ""), ("<object/>", ""), ("<button>Share", ""), ("<select><option>A<option>B", ""), ("<svg><path d='m'>", ""), ("<button>a<button>b</button>", "")]
    + [("<svg><svg><text>x</text></svg><p>y</p></svg>", ""), ("<noscript><p>Enable it</p></noscript>", ""), ("<button>a<script>'<button>'</script></button>", ""), ("<p>so <math><mi>x</mi></math> is</p>", "so x is"), ("<object><p>instead of it</p></object>", "instead of it")],
)
def test_extraction_keeps_what_follows_elements_without_text(odd, kept):
    page = f"<html><body><article><p>one two three</p>{odd}<p>four five six</p><p>seven <b>eight</b></p></article><footer>me</footer></body></html>"
    want = ["one two three", *filter(None, [kept]), "four five six", "seven eight"]
    assert html_extract.main_text(page, html_extract.trained_weights()) == "\n\n".join(want)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- never closed <p>x", "<script>x", "<nav>menu</nav>", "a < b", "</p></div>", "<p " * 500, "<" * 5000])
def test_extraction_of_broken_pages(page):
    assert isinstance(html_extract.main_text(page, html_extract.trained_weights()), str)


def labelled_text(pieces):
    blocks = [b for p, good in pieces if good for b in re.split(r"</?(?:p|h\d|li|ul|ol|div|header|blockquote|table|tbody|tr|td|pre|figure|figcaption|section|article)\b[^>]*>", p.replace("<br>", " "))]
    return "\n\n".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)))


def test_extraction_of_held_out_layouts_and_names():
    """Made pages of another seed: half of the class names mean nothing, and none of these was seen."""
    w = html_extract.trained_weights()
    for seed in (99, 5, 11):
        pages = html_extract.labelled_pages(100, seed=seed)
        same = [labelled_text(p) == html_extract.main_text("".join(x for x, _ in p), w) for p in pages]
        assert np.mean(same) >= 0.9


@pytest.mark.parametrize("name", ["user-feedback", "qx-17"])
@pytest.mark.parametrize("kind", ["div", "li", "article"])
def test_comments_without_telling_names_at_the_end_of_an_article_go(name, kind):
    body = "".join(f"<p>{'one two three four five six seven eight nine ten ' * 3}{i}</p>" for i in range(6))
    said = "".join(f"<{kind}><b>Someone</b><p>I disagree with all of this, and say so at some length {i}</p></{kind}>" for i in range(4))
    page = f"<body><article><h1>Head</h1>{body}<section><h2>More</h2>{body}</section><section class='{name}'><h2>Views</h2>{said}</section></article><footer>me</footer></body>"
    text = html_extract.main_text(page, html_extract.trained_weights())
    assert "disagree" not in text and text.count("one two") == 36 and "More" in text and text.startswith("Head")


def test_deeply_nested_pages_take_time_and_memory_in_proportion():
    """100,000 nested elements, each with class names of its own, and as many end tags that nothing opens."""
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    page = "".join(f'<div class="{name(i)} x{name(i)}">' for i in range(100_000)) + "</i>" * 100_000 + "<p>a text</p>" + "<b><p>x" * 20_000
    w = html_extract.trained_weights()
    tracemalloc.start()
    began = time.perf_counter()
    runs, elements = html_extract.parsed(page)
    w.scores(runs, elements)
    took, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(elements) == 140_001 and took < 60 and most < 500e6


@pytest.mark.parametrize("name", ["skyscraper", "zone7", "qx-17"])
def test_extraction_leaves_out_parts_with_unseen_names(name):
    body = "".join(f"<p>{'one two three four five six seven eight nine ten ' * 3}{i}</p>" for i in range(6))
    page = f"<body><div class='top'>Site</div><article><h1>Head</h1>{body}<div class='{name}'><p>Buy this now</p></div>{body}</article><div class='{name}'><p>I disagree with all of this</p></div></body>"
    text = html_extract.main_text(page, html_extract.trained_weights())
    assert text.startswith("Head\n\none two") and "Buy" not in text and "disagree" not in text and "Site" not in text and text.count("one two") == 36


def test_the_region_decides(monkeypatch):
    w = html_extract.trained_weights()
    pages = pd.read_parquet(f"{SF}/pages.parquet").html.tolist()
    found = [html_extract.main_text(p, w) for p in pages]
    scored = [w.scores(*html_extract.parsed(p)) for p in pages]
    assert all(s >= 0 for x, p in zip(scored, pages) for s, r in zip(x, html_extract.parsed(p)[0]) if r.text is not None)
    assert all(s < 0 for x, p in zip(scored, pages) for s, r in zip(x, html_extract.parsed(p)[0]) if r.text is None)
    monkeypatch.setattr(html_extract, "region", lambda scores: (0, len(scores)))
    assert np.mean([html_extract.main_text(p, w) != t for p, t in zip(pages, found)]) > 0.9


def test_extraction_of_repeated_rows_clashing_columns_and_nothing(spark):
    rows = spark.createDataFrame([(1, PAGE, "old", 5), (1, PAGE, "old", 5), (2, None, None, None)], "page_id long, html string, text string, n_chars long")
    out = html_extract.extracted(rows)
    assert out.columns == rows.columns and sorted(r.text for r in out.collect()) == ["", *["Title & more\n\nOne two\n\nthree four\n\nitem"] * 2]
    assert html_extract.extracted(rows.limit(0)).count() == 0


def test_region_is_the_maximum_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.normal(size=int(rng.integers(0, 12))).round(1).tolist()
        at, stop = html_extract.region(s)
        best = max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert abs(sum(s[at:stop]) - best) < 1e-9


def test_extraction_on_the_tables(spark):
    out = html_extract.op7_html_extract(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/pages.parquet"), on="page_id")
    for r in out.itertuples():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>", article)]
        assert r.text == "\n\n".join(filter(None, blocks)) and r.n_chars == len(r.text)
