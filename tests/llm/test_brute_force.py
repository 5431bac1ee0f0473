"""The classifiers, HTML extraction and the pipeline against plain, slow versions of themselves."""

from __future__ import annotations

import itertools
import os
import random
import re
import time
import unicodedata
from html import unescape

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from clickweave.llm import html_wrapper, language_id, mixing, quality, queries, simhash, toxicity
from clickweave.shared import stored

SMALL, DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def sample(seed, n=40):
    r = random.Random(seed)
    words = {"en": "the and of thing ther shen".split(), "de": "der die und schön über keit".split(), "fr": "les des une être garçon".split()}
    return [(" ".join(r.choices(words[k], k=r.randint(2, 12))), k) for k in sorted(words) for _ in range(n)]


def ngrams(text):
    """Distinct n-grams, n up to 3, of the lower-cased letters, everything else one blank."""
    kind = lambda c: unicodedata.category(c)[0] in "LM"
    s = re.sub(" +", " ", " " + "".join(c if kind(c) else " " for c in text.lower()) + " ")
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def test_language_margins_are_those_of_the_kernel_and_the_ridge_by_hand():
    train, new = sample(1), sample(2, 8)
    pdf = pd.DataFrame(train, columns=["t", "l"]).drop_duplicates()
    model = language_id.fit(pdf, "t", "l", landmarks=3 * 40)
    kernel = lambda a, b: len(ngrams(a) & ngrams(b)) / (len(ngrams(a)) * len(ngrams(b))) ** 0.5
    marks = list(pdf.t)  # more landmarks than texts: every one is a landmark
    own = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = own @ root
    each = np.array([len(pdf) / 3 / (pdf.l == k).sum() for k in pdf.l])
    want = {}
    for k in ("de", "en", "fr"):
        y = np.where(pdf.l == k, 1.0, -1.0)
        w = np.linalg.solve(sum(c * np.outer(v, v) for c, v in zip(each, z, strict=True)) + language_id.RIDGE * len(z) * np.eye(z.shape[1]), sum(c * t * v for c, t, v in zip(each, y, z, strict=True)))
        want[k] = [np.array([kernel(a, b) for b in marks]) @ root @ w for a, _ in new]
    found = model.rows([language_id.grams(a) for a, _ in new]) @ model.weights
    assert np.allclose(found, np.stack([want[k] for k in model.languages], 1), atol=2e-3)
    scored = model.score([a for a, _ in new])
    assert list(scored.lang) == [max(want, key=lambda k: want[k][i]) for i in range(len(new))]


def test_ties_go_to_the_first_language():
    rows = [(t, k) for t, _ in sample(5, 10) for k in ("bb", "aa")]  # both have all texts
    model = language_id.fit(pd.DataFrame(rows, columns=["t", "l"]), "t", "l")
    assert set(model.score([t for t, _ in rows]).lang) == {"aa"}


def test_a_machine_sums_over_all_pairs_of_terms():
    r = np.random.default_rng(3)
    texts = ["awful people of that group", "a plain sentence", "", "awful words", "über group"]
    found = [toxicity.terms(t) for t in texts]
    features = np.unique(np.concatenate(found))[::2]
    machine = toxicity.Machine(-0.3, features, r.normal(size=len(features)).astype(np.float32), r.normal(size=(len(features), 4)).astype(np.float32))
    for t, score in zip(texts, machine.score(texts).score, strict=True):
        on = [i for i, f in enumerate(features) if f in set(toxicity.terms(t))]
        margin = -0.3 + sum(machine.linear[i] for i in on)
        for i, j in itertools.combinations(on, 2):
            margin += float(machine.factors[i] @ machine.factors[j])
        assert score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-4)


def test_a_document_has_the_length_weighted_mean_of_its_lines():
    r = np.random.default_rng(4)
    chain = quality.Chain(r.normal(size=3 + 3 * quality.OWN) / 3, r.normal(size=(2, 2)), (2.0, -0.5))
    for text in ["one line", "First line here.\n\n|| 12 || 13\nFirst line here.", ""]:
        features, lengths = quality.line_features(text)
        u = features @ chain.weights
        weight = {y: np.exp(sum(a * b for a, b in zip(u, y, strict=True)) + sum(chain.links[i, j] for i, j in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=len(u))}
        good = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(len(u))]
        assert list(lengths) == [max(1, len(x)) for x in text.split("\n")]
        mean = sum(g * n for g, n in zip(good, lengths, strict=True)) / sum(lengths)
        assert chain.score([text]).score[0] == pytest.approx(1 / (1 + np.exp(-(2.0 * mean - 0.5))))


def test_a_million_lines_are_scored_in_blocks(monkeypatch):
    r = np.random.default_rng(5)
    chain = quality.Chain(r.normal(size=3 + 3 * quality.OWN) / 3, r.normal(size=(2, 2)), (2.0, -0.5))
    texts = ["a || b\n" * 70 + "12 | 13\n\nHello World World.", "", None, "\n", "漢字 x\x85y z\n" * 9]
    whole = chain.score(texts)
    for text in texts:
        features, lengths = quality.line_features(text)
        scores, again = quality.line_scores(text, chain.weights)
        assert np.allclose(features @ chain.weights, scores) and list(lengths) == list(again)
    monkeypatch.setattr(quality, "LINES", 4)
    assert np.allclose(chain.score(texts).score, whole.score) and np.allclose([chain.score([t]).score[0] for t in texts], whole.score)
    monkeypatch.undo()
    began = time.process_time()
    assert 0 < chain.score(["".join(f"line {i % 1000} here\n" for i in range(1_000_000))]).score[0] < 1
    assert time.process_time() - began < 20


def test_the_language_fit_has_a_bound_for_any_script():
    r = np.random.default_rng(6)
    texts = ["".join(map(chr, r.integers(0x4E00, 0x9F00, 4000))) for _ in range(24)]
    pdf = pd.DataFrame({"t": texts, "l": ["a", "b"] * 12})
    model = language_id.fit(pdf, "t", "l", width=5000)
    assert model.presence.shape == (24, 5000) and list(model.score(texts).lang) == list(pdf.l)
    marks = [language_id.grams(t) for t in texts]
    found, n = np.unique(np.concatenate(marks), return_counts=True)
    assert list(model.vocabulary) == sorted(found[np.lexsort((found, -n))[:5000]])


def test_n_grams_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Der schnelle  Fuchs, 12 日本語の本 springt über den Hund. " * 5
    whole = language_id.grams(text)
    for cut in (1, 2, 3, 7):
        monkeypatch.setattr(language_id, "CUT", cut)
        assert np.array_equal(language_id.grams(text), whole)


def article_of(html):
    """The text of the one article of a page, for pages whose articles hold no other things."""
    inner = re.search(r"<article>(.*?)</article>", html or "", re.S)
    parts = re.split(r"</?(?:h1|p|div|ul|li|table|tr|td|blockquote)\b[^>]*>", re.sub(r"<br[^>]*>", " ", inner[1])) if inner else []
    return "\n".join(t for x in parts if (t := " ".join(unescape(re.sub(r"<[^>]+>", "", x)).split())))


@data
def test_pages_give_the_whole_of_their_articles_and_nothing_else(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").toPandas().set_index("page_id").html
    found = queries.QUERIES["op6_html_extraction"](spark, DIR).toPandas().set_index("page_id")
    assert len(found) == len(pages)
    for i, html in pages.items():
        assert found.text[i] == article_of(html), i
        assert found.n_chars[i] == len(found.text[i])


def test_the_wrapper_decides_where_names_and_tags_are_neutral(spark):
    r = random.Random(6)
    said = lambda n: " ".join(r.choice("river town story news people north".split()) + str(r.randrange(99)) for _ in range(n))
    pages, want = [], []
    for i in range(24):
        title, by, parts, quote = said(4), said(2), [said(r.randint(4, 60)) for _ in range(r.randint(1, 6))], said(9)
        menu = "".join(f"<li><a href='/{said(1)}'>{said(1)}</a></li>" for _ in range(5))
        body = f"<div class='k1 {'k9' * (i % 2)}'><ul>{menu}</ul></div><div class=k2><h1>{title}</h1><span>by {by}</span>{''.join(f'<p>{x}</p>' for x in parts)}<div class=q><blockquote>{quote}</blockquote></div></div><div class=k3>{said(3)}</div>"
        pages.append((i, "http://h.org/", f"<html><body><div>The same line on all pages</div>{body}</body></html>"))
        want.append("\n".join([title, f"by {by}", *parts, quote]))
    found = {x.page_id: x.text for x in html_wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(24)] == want
    # by the page alone, menu and footer would stay
    assert html_wrapper.main_text(pages[0][2], None).count("\n") > want[0].count("\n") + 5


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article class='post has-comments'><p>hello</p></article>", "hello"),
        ("<div id=content class='no-sidebar'>hello</div>", "hello"),
        ("<article><p class='notice-period'>a</p><section id='share-prices'>b</section></article>", "a\nb"),
        ("<article>x<div class='reader-comments'>c</div><div class=commentList>c</div><div id='cookieNotice'>n</div><div class='sidebar-left ads'>s</div></article>", "x"),
    ],
)
def test_names_are_noise_by_their_head_word(html, text):
    assert html_wrapper.main_text(html, None) == text


def rooted(pairs, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_long_chains_of_fingerprints_are_one_component(spark):
    order = list(range(1000))
    random.Random(2).shuffle(order)
    for path in (range(1000, 0, -1), order):
        links = list(itertools.pairwise(path))
        found = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(found) == 1000 and {x.component for x in found} == {min(path)}
    r = random.Random(9)
    links = [(a, b) for a, b in ((r.randrange(300), r.randrange(300)) for _ in range(170)) if a != b]
    found = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {x.id: x.component for x in found} == rooted(links, {x for e in links for x in e})


@data
def test_the_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    kernel, machine = language_id.trained(spark, SMALL), toxicity.trained(spark, SMALL)
    told = kernel.score(docs.text.tolist(), reject=True)
    docs = docs[(told.lang != "und").to_numpy() & (told.score >= corpus_pipeline.LEAST_SCORE).to_numpy()]
    docs = docs[machine.score(docs.text.tolist()).score.to_numpy() < 0.5]
    prints = {i: simhash.fingerprint(t) & (1 << 64) - 1 for i, t in zip(docs.doc_id, docs.text, strict=True)}
    close = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    docs = docs[[i == k for i, k in rooted(close, list(prints)).items()]]
    split = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    items = [split(t) for t in spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas().text.dropna()]
    wanted = [(min(5, len(w)), runs(w, min(5, len(w)))) for w in items if w]
    docs = docs[[not any(len(s & runs(split(t), n)) >= round(0.8 * len(s), 9) for n, s in wanted) for t in docs.text]]
    kept = spark.createDataFrame(docs[["doc_id", "text", "lang", "source", "n_chars"]].astype({"doc_id": int}).to_dict("records"), "doc_id long, text string, lang string, source string, n_chars long")
    # mixing: numpy's own raking and budget; topics and draws are the operator's
    cells = mixing.decide(kept).select("doc_id", "source", "lang", "topic", "n_tokens", mixing.drawn(mixing.F.col("doc_id"), mixing.F.col("text"), 42).alias("u")).toPandas()
    assert (cells.n_tokens == cells.doc_id.map(docs.set_index("doc_id").text.map(lambda t: len(t.split())))).all()
    sums = cells.groupby(["source", "lang", "topic"]).n_tokens.sum().astype(float)
    weight = sums.copy()
    want = {d: (t := sums.groupby(level=d).sum() ** mixing.TEMPER) / t.sum() for d in mixing.DIMENSIONS}
    for _ in range(mixing.ROUNDS):
        for d in mixing.DIMENSIONS:
            at = weight.index.get_level_values(d)
            weight = weight * want[d].loc[at].to_numpy() / weight.groupby(level=d).sum().loc[at].to_numpy()
    rate, low, high = (weight / sums).to_numpy(), 0.0, 1e12
    for _ in range(200):  # the factor by bisection
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, rate * mid) * sums.to_numpy()).sum() < mixing.SHARE * sums.sum() else (low, mid)
    chance = pd.Series(np.minimum(1, rate * high), index=sums.index)
    of = [chance[k] for k in zip(cells.source, cells.lang, cells.topic, strict=True)]
    assert set(cells.doc_id[cells.u < np.array(of) - 1e-4]) <= (found := {x.doc_id for x in stored(corpus_pipeline.run(spark, SMALL)).collect()}) <= set(cells.doc_id[cells.u < np.array(of) + 1e-4])
    assert found


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article>x<div class='comments-open'>c</div><section class='ad-open'>a</section><p class='advert'>b</p></article>", "x"),
        ("<article><p class='related'>a</p><h2 class='banner'>b</h2><p class='social'>c</p><p class='alert'><a href='/'>link</a></p></article>", "a\nb\nc"),
        ("<article class='post comments-open'><h1>t</h1><p>x</p></article>", "t\nx"),
        ("<div class='widget'><h1>t</h1><article>x</article></div><div class='widget'>w</div>", "x"),
        ("<div class='widget'><h1>t</h1><p>x</p></div><div class='widget'>w</div>", "t\nx"),
        ("<header class='banner'><h1>site</h1></header><div class='comment'>c</div><p>x", "x"),
    ],
)
def test_names_give_way_to_other_evidence(html, text):
    assert html_wrapper.main_text(html, None) == text


def test_doubtful_texts_go_where_the_host_repeats_them(spark, monkeypatch):
    monkeypatch.setattr(html_wrapper, "FAN", 2)  # several rounds of merging
    page = "<article><h1>Dish {i}</h1><p class='notice'>We use small files</p><p>{i} eggs</p><p class='alert'>Mind the {i}th step</p><h2>Method</h2></article>"
    df = spark.createDataFrame([(i, f"http://h.org/{i}", page.format(i=i)) for i in range(40)], "page_id long, url string, html string").repartition(13)
    found = {x.page_id: x.text for x in html_wrapper.extract(df).collect()}
    assert found == {i: f"Dish {i}\n{i} eggs\nMind the {i}th step\nMethod" for i in range(40)}


def test_wrappers_of_pages_that_are_all_different_are_bounded(monkeypatch):
    monkeypatch.setattr(html_wrapper, "LONGEST", 256)
    r = random.Random(1)
    block = lambda i, k: f"<div class='{''.join(r.choice('abcdefghij') for _ in range(6))}'>text {i} {k}</div>"
    page = lambda i: f"<html><body><div class=top>menu</div>{''.join(block(i, k) for k in range(30))}<div class=end>imprint</div></body></html>"
    pages = [page(i) for i in range(120)]
    (made,) = html_wrapper.induce(iter([html_wrapper.pd.DataFrame({"host": "h", "html": pages})]))
    blocks = html_wrapper.json.loads(made.wrapper[0])
    assert sum(map(html_wrapper.size, blocks)) <= 256 + 100
    for i, html in enumerate(pages):
        assert html_wrapper.main_text(html, made.wrapper[0]) == "\n".join(f"text {i} {k}" for k in range(30))


def test_long_streams_are_compared_as_wholes():
    r = random.Random(3)
    for most in (5, 400, 5000):
        a = tuple(str(r.randrange(most)) for _ in range(2000))
        b = tuple(x for x in a if r.random() < 0.9) + a[:300]
        i = k = same = 0
        for equal, i0, j, k0, l in html_wrapper.matched(a, b):
            assert (i0, k0) == (i, k) and (not equal or a[i0:j] == b[k0:l])
            i, k, same = j, l, same + equal * (j - i0)
        assert (i, k) == (len(a), len(b))
        assert same > (1000 if most > 5 else 500)
