"""The corpus operators on small tables: brute force, edge cases, planted cases."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickweave.llm import chat, decontaminate, html_wrapper, language_id, merkle, mixing, quality, simhash, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some words", "en", "a", 1), (4, "the thing of " * 10000, "en", "b", 130000), (5, "12 34", "de", "b", 5)]


def docs(spark, rows=EDGE):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOC)


def texts(language, n, seed):
    words = {"en": "the and of thing ther shen ention".split(), "de": "der die und schön über keit ung".split()}[language]
    r = random.Random(seed)
    return [" ".join(r.choices(words, k=r.randint(1, 40))) for _ in range(n)]


# chat


def brute(roles):
    """Least cost over all outcomes: role of each turn, whether it merges, which empties come before."""
    best = None
    for outcome in itertools.product((1, 2, 3), (False, True), repeat=len(roles)):
        cost, state, ok = 0, 0, True
        for r, to, merge in zip(roles, outcome[::2], outcome[1::2], strict=True):
            cost += chat.RELABEL * (r != to)
            if merge:
                ok &= to == state
                cost += chat.MERGE
            elif (state, to) in chat.AFTER:
                cost += chat.INSERT * len(chat.AFTER[state, to])
            else:
                ok = False
            state = to
        if ok:
            cost += chat.INSERT * len(chat.CLOSING[state])
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("roles", [r for n in (1, 2, 3) for r in itertools.product(range(4), repeat=n)][::3])
def test_repair_costs_the_least(roles):
    roles = list(roles)
    for k in range(len(roles)):
        blocks = [b for b in (roles[:k], roles[k:]) if b]
        least, path = chat.join_blocks([chat.matrix(b) for b in blocks])
        assert least == brute(roles)
        spent = sum(c[0] for b, (f, t) in zip(blocks, path, strict=True) for c in chat.trace(b, f, t))
        assert spent + chat.INSERT * len(chat.CLOSING[path[-1][1]]) == least


def test_repair_renders_and_keeps_what_has_no_place(spark):
    chats = spark.createDataFrame(
        [(1, 0, "user", "a<|im_end|>", 1), (1, 0, "user", "a<|im_end|>", 1), (1, 2000, "USER ", "b", 1), (2, 5, None, None, 1), (None, 1, "user", "x", 1), (3, None, "user", "y", 1)],
        "conv_id long, turn long, role string, text string, block int",
    )
    found = chat.repair(chats).collect()
    shown = {c: "".join(r.rendered for r in sorted((r for r in found if r.conv_id == c and r.rendered), key=lambda r: (r.turn, r.step))) for c in (1, 2)}
    assert shown[1] == "<|im_start|>user\na< |im_end|>\nb<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert shown[2] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert sum(r.action == "unplaced" for r in found) == 2
    assert chat.repair(chats.limit(0)).count() == 0


def test_crowded_and_long_conversations_cost_the_least(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)  # turns of a block, blocks of a stretch
    r = random.Random(7)
    roles = ("user", "assistant", "system", "robot")
    rows = [(1, t, r.choice(roles), f"{t}") for t in range(90)] + [(2, 5, r.choice(roles), f"x{i}") for i in range(60)] + [(2, t, r.choice(roles), "y") for t in (0, 1, 4, 6, 30, 31)] + [(3, 0, "user", "z")] * 50
    found = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c in (1, 2, 3):
        mine = sorted((x for x in found if x.conv_id == c), key=lambda x: (x.turn, x.turn_role, x.turn_mark, x.step))
        given = [x.given_role for x in mine if x.action not in ("insert", "end")]
        assert sorted(given) == sorted(x[2] for x in {x for x in rows if x[0] == c})
        order = [chat.ROLES.index(x) + 1 if x in chat.ROLES else 0 for x in given]
        assert sum(x.cost for x in mine) == chat.join_blocks([chat.matrix(order)])[0]
        opened = [x.role for x in mine if x.role and not x.action.endswith("merge")]
        assert opened[1 if opened[0] == "system" else 0 :] == ["user", "assistant"] * (len(opened) // 2)
        assert mine[-1].action == "end"


# decontamination


def test_leaks_are_found_inside_long_documents_by_brute_force(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    bench = [(i, " ".join(word() for _ in range(r.choice([3, 12, 30, 70])))) for i in range(20)] + [(20, None), (21, "..."), (3, "again here")]
    rows = []
    for i in range(60):
        own = [word() for _ in range(r.choice([5, 300, 3000]))]
        if i % 2:
            part = (bench[i % 20][1]).split()
            if i % 3 == 0 and len(part) > 20:
                part[len(part) // 2] = "changed"
            own[len(own) // 2 : len(own) // 2] = part
        rows.append((i, " ".join(own).upper()))
    rows += [(99, None), (98, ""), (1, rows[1][1])]
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    want = set()
    for d, t in rows:
        for b, x in bench:
            w, v = split(x), split(t)
            n = min(5, len(w))
            a, c = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set(), {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            if a and len(a & c) >= round(0.8 * len(a), 9):
                want.add((d, b))
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.find_leaks(docs(spark, rows), items)
    assert {(x.doc_id, x.item_id) for x in found.collect()} == want
    left = {x.doc_id for x in decontaminate.decontaminate(docs(spark, rows), items).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.find_leaks(docs(spark, []), items).count() == 0
    assert decontaminate.find_leaks(docs(spark, rows), items.limit(0)).count() == 0


# language ID, quality, toxicity


def test_language_is_learned_and_edges_are_defined(spark):
    rows = [(i, t, lang) for lang in ("en", "de") for i, t in enumerate(texts(lang, 60, 1))]
    kernel = language_id.train(docs(spark, rows))
    found = language_id.identify(docs(spark, [(i, t) for i, t in enumerate(texts("de", 30, 2))]).withColumn("SCORE", F.lit(9)), kernel)
    assert {r.lang_pred for r in found.collect()} == {"de"}
    edge = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs(spark), kernel).collect()}
    assert edge[1] == edge[2] == edge[5] == ("und", 0.0)
    assert edge[4][0] == "en"
    assert language_id.identify(docs(spark, []), kernel).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs(spark, rows), language_id.train(docs(spark, []))).collect()} == {"und"}


def test_toxicity_learns_a_pair_that_only_counts_together():
    r = random.Random(5)
    rows = []
    for _ in range(800):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = r.choices("plain words that say nothing much".split(), k=6) + ["awful"] * insult + ["foreigners"] * group
        r.shuffle(words)
        rows.append((" ".join(words), int(insult and group)))
    m = toxicity.fit([t for t, _ in rows[:600]], np.array([y for _, y in rows[:600]]), np.ones(600))
    s = m.score([t for t, _ in rows[600:]])["score"].to_numpy() >= 0.5
    assert (s == np.array([y for _, y in rows[600:]], bool)).mean() > 0.97


def test_classifiers_score_edge_cases(spark):
    rows = [(i, "good sentence here. Another one follows it.\n" * 3 if i % 2 else "|| ## 77 | %% | 12 |\n" * 4) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(80)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    chain, machine = quality.train(docs(spark, rows), labels), toxicity.train(docs(spark, rows), labels)
    for scored in (quality.score_quality(docs(spark, rows + EDGE), chain), toxicity.score_toxicity(docs(spark, rows + EDGE), machine)):
        found = [(r.doc_id, r.score) for r in scored.collect()]
        assert len(found) == 86
        assert all(0 <= s <= 1 for _, s in found)
        assert {bool(s >= 0.5) for i, s in found[1:80:2]} == {scored.columns[-1] == "line_quality"}
    none = quality.train(docs(spark, rows), labels.limit(0))
    assert quality.score_quality(docs(spark), none).count() == 6
    assert toxicity.score_toxicity(docs(spark), toxicity.train(docs(spark, rows), labels.limit(0))).count() == 6


def test_forward_backward_is_the_sum_over_all_labellings():
    r = np.random.default_rng(2)
    links = r.normal(size=(2, 2))
    chains = [r.normal(size=n) for n in (1, 4, 2)]
    good, _, _ = quality.marginals(chains, links)
    for u, g in zip(chains, good, strict=True):
        weights = {y: np.exp(sum(u[i] * y[i] for i in range(len(u))) + sum(links[y[i - 1], y[i]] for i in range(1, len(u)))) for y in itertools.product((0, 1), repeat=len(u))}
        whole = sum(weights.values())
        assert np.allclose(g, [sum(w for y, w in weights.items() if y[i]) / whole for i in range(len(u))])


# SimHash


def test_fingerprint_follows_its_definition():
    import xxhash

    words = "the Quick brown fox jumps over".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint("the QUICK  brown\tfox jumps over") & (1 << 64) - 1 == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("a b") & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b", 42)


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 0])
def test_components_are_those_of_all_pairs(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    r = random.Random(3)
    flip = lambda x, k: x ^ sum(1 << b for b in r.sample(range(64), k))
    fps = {0, 3}
    for _ in range(25):
        x = r.getrandbits(64)
        fps |= {x, *(flip(x, r.choice([1, 2, 4, 5, 6])) for _ in range(4))}
    centre = r.getrandbits(64)
    fps |= {flip(centre, r.choice([1, 2, 3])) for _ in range(150)}
    order = sorted(fps)
    least = list(range(len(order)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(order)), 2):
            if (order[i] ^ order[j]).bit_count() <= 4 and least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                changed = True
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(order)]
    found = {x.id: x.component for x in simhash.linked_components(simhash.checkpointed(spark.createDataFrame(signed, "id long, fp long"))).collect()}
    assert {i: found.get(i, i) for i in range(len(order))} == dict(enumerate(least))


def test_copies_share_a_component_and_one_stays(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(3, base), (7, base.upper()), (9, " ".join(f"v{i}" for i in range(50))), (5, None), (6, "")]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert found == {3: 3, 7: 3, 9: 9, 5: 5, 6: 5}
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, [*rows, rows[0]])).collect()) == [3, 5, 9]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.near_duplicates(docs(spark)).count() == 6

def test_one_stays_by_its_own_text(spark):
    text = [" ".join(f"{c}{i}" for i in range(200)) for c in "abcdefgh"]
    near = text[6].replace("g7 ", "x7 ")
    rows = [(1, text[0]), (None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (7, text[3]), (7, text[0]), (7, text[4]), (7, text[4]), (9, text[5]), (8, text[6]), (None, near)]
    kept = sorted(((r.doc_id or 0), r.text) for r in simhash.keep_one(docs(spark, rows)).collect())
    linked = bin((simhash.fingerprint(text[6]) ^ simhash.fingerprint(near)) & (2**64 - 1)).count("1") <= simhash.TAU
    assert linked
    assert kept == sorted([(1, text[0]), (0, text[1]), (0, text[2]), (7, text[3]), (7, text[4]), (9, text[5]), (8, text[6])])
    assert simhash.keep_one(docs(spark, [])).count() == 0


# HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;", "plain <text>"),
        ("<nav>menu<p>x</nav><article><h1>T &amp x</h1><p>one<b>two</b>  three<br>four<div class='comments'><p>no</div><p>five</article><footer>f</footer>", "T & x\nonetwo three four\nfive"),
        ("<body><div id=menu>m</div><div>hello <i>w</i>orld</div><form>x</form><!-- c --><script>var a='<p>';</script></body>", "hello world"),
        ("<article class='comment'>x</article><main>yes</main>", "yes"),
        ("<article><aside>no</aside><p>yes<p>more", "yes\nmore"),
    ],
)
def test_main_text_of_one_page(html, text):
    assert html_wrapper.main_text(html, None) == text


def test_wrappers_fold_repeats_and_make_the_rest_optional(spark):
    page = lambda n, extra="": f"<nav><ul>{'<li><a>x</a></li>' * n}</ul></nav><article><h1>t</h1>{extra}{''.join(f'<p>text {i}</p>' for i in range(n))}</article><footer>f</footer>"
    rows = [(i, "http://h.org/x", page(i % 5 + 1, "<p><b>b<br>" if i % 2 else "")) for i in range(10)] + [(10, None, None), (11, "http://h.org/y", ""), (12, "http://z", "<p>" * 5000)]
    pages = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: r.text for r in html_wrapper.extract(pages).collect()}
    assert found[3] == "t\nb\ntext 0\ntext 1\ntext 2\ntext 3"
    assert found[4] == "t\n" + "\n".join(f"text {i}" for i in range(5))
    assert found[10] == found[11] == found[12] == ""
    assert html_wrapper.extract(pages.limit(0)).count() == 0
    wrapper = {r.host: r.wrapper for r in html_wrapper.wrappers(pages).collect()}["h.org"]
    assert '"+li"' in wrapper and '"+p"' in wrapper



def test_noise_of_one_page_spares_its_host(spark):
    long = "c" * 90
    pages = ["<article><p>one</p><p>two</p></article>", "<article><p hidden>gone</p><p>three</p></article>", "<article><div>four</div></article>", '<article><div role="alert">gone</div>five</article>']
    pages += [f'<article><div class="{long}">six</div></article>', f'<article><div class="{long} promo">gone</div></article>', '<article><p style="overflow:hidden" data-id="ad">seven</p></article>']
    rows = spark.createDataFrame([(i, f"http://h.org/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_wrapper.extract(rows).collect()} == dict(enumerate(["one\ntwo", "three", "four", "five", "six", "", "seven"]))



@pytest.mark.parametrize("extra", ["", "".join(f"<i class='{a}{b}{c}'></i>" for a, b, c in itertools.product("cdefghijklmnop", repeat=3))])
def test_wrappers_tell_template_from_content_without_articles(spark, extra):
    said = lambda i: f"story {i} begins with news of day {i} and goes on for long"
    page = lambda i: f"<body><div>All rights of this site</div>{extra}<div class=x><h1>title {i}</h1><span>told by <b>us</b> for {i}</span></div><div><i>Made in the north</i></div>"
    rows = [(i, f"http://h.org/{i}", page(i) + f"<p>{said(i)}</p>") for i in range(8)]
    rows += [(10 + i, f"http://copy.org/{i}", page(1) + f"<p>{said(1)}</p><p>{i}</p>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_wrapper.extract(pages).collect()}
    assert all(found[i] == f"title {i}\ntold by us for {i}\n{said(i)}" for i in range(8))
    assert all("title 1" in found[10 + i] and said(1) in found[10 + i] for i in range(8))


# mixing


def test_weights_meet_their_targets_and_samples_their_budget(spark):
    r = random.Random(4)
    rows = [(i, "word " * r.randint(1, 60), r.choice(["en", "en", "de"]), r.choice("abc")) for i in range(3000)]
    targets = {"source": {"a": 1, "b": 1, "c": 2}, "lang": {"en": 0.5, "de": 0.5}}
    found = mixing.decide(docs(spark, rows), targets=targets, share=0.3, topic_of=F.lit("t")).toPandas()
    cell = found.groupby(["source", "lang"]).agg(weight=("weight", "first"), n=("n_tokens", "sum"), p=("probability", "first")).reset_index()
    assert np.allclose(cell.groupby("source").weight.sum(), [0.25, 0.25, 0.5], atol=1e-5)
    assert np.allclose(cell.groupby("lang").weight.sum(), [0.5, 0.5], atol=1e-5)
    assert (cell.p * cell.n).sum() == pytest.approx(0.3 * cell.n.sum())
    assert found[found.sampled].n_tokens.sum() == pytest.approx(0.3 * cell.n.sum(), rel=0.1)
    # brute force: numpy's own raking
    w = cell.pivot(index="source", columns="lang", values="n").to_numpy(float)
    for _ in range(200):
        w *= (np.array([0.25, 0.25, 0.5]) / w.sum(1))[:, None]
        w *= 0.5 / w.sum(0)
    assert np.allclose(cell.pivot(index="source", columns="lang", values="weight").to_numpy(), w, atol=1e-5)


def test_topics_are_learned_from_every_document_in_any_order(spark):
    rng = random.Random(3)
    vocabulary = [[f"{t}{i}" for i in range(30)] for t in "abc"]
    rows = [(i, " ".join(rng.choices(vocabulary[i % 3], k=12) + rng.choices(["the", "of", "and"], k=5)), ("en", "fr")[i % 2]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found, again = (mixing.learn_topics(x, topics=3) for x in (df.repartition(3), df.orderBy(F.desc("doc_id")).coalesce(1)))
    assert (found.centres == again.centres).all() and (found.rarity == again.rarity).all()
    slots = [np.array(r[0]) for r in df.select(mixing.counted(F.col("text"))["slots"]).collect()]
    holding = np.zeros(mixing.SLOTS)
    for x in slots:
        holding[np.unique(x)] += 1
    assert np.allclose(found.rarity, np.log(1501 / (1 + holding)), atol=1e-5)  # of all 1,500, not of some
    plain = mixing.Topics(found.rarity, {"": np.zeros(mixing.SLOTS, np.float32)}, found.centres)
    u, langs = plain.vectors(slots, [""] * 1500), [r[2] for r in rows]
    for x in ("en", "fr"):
        assert np.allclose(found.means[x], u[[k == x for k in langs]].mean(0), atol=1e-5)
    x = found.vectors(slots, langs)
    owner = (x @ found.centres.T).argmax(1)
    sums = np.stack([x[owner == k].sum(0) for k in range(3)])
    assert np.allclose(sums / np.linalg.norm(sums, axis=1, keepdims=True), found.centres, atol=1e-2)  # a fixed point over all documents
    names = found.names(slots, langs)
    assert len({(n, i % 3) for i, n in enumerate(names)}) == 3


def test_words_of_a_block_have_the_slots_of_the_expression(spark):
    texts = ["", None, " \t a  B\u00a0c\n\x0b\x0c\rD ", "ΣΑΣ ΟΔΟΣ. İstanbul Straße", "x" * 31 + " " + "y" * 32 + " " + "Z" * 1000, "a", " ", "ab abc abcd abcde abcdefg abcdefgh abcdefghijk abcdefghijklmnop", "no end"] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    want = [(r[0]["n"], r[0]["slots"]) for r in df.orderBy("i").select(mixing.counted(F.col("text"))).collect()]
    column = df.orderBy("i").select(mixing.lowered(F.col("text")).alias("t")).toArrow()["t"].combine_chunks()
    found = []
    for _, slots, words in mixing.texts_in_blocks(column):
        found += [(int(n), part.tolist()) for n, part in zip(words, np.split(slots, np.cumsum(words)[:-1]), strict=True)]
    assert found == want


def test_a_pass_of_the_topics_gives_one_row_a_slot_and_task(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 500}" for j in range(40)), "en") for i in range(600)], "doc_id long, text string, lang string")
    table = mixing.features(df.coalesce(1), "text", "lang")
    assert table.count() == 5  # a row a block
    rng = np.random.default_rng(1)
    fit = mixing.Fit({"en": 0}, np.ones(mixing.SLOTS), np.zeros((2, mixing.SLOTS)), rng.normal(size=(12, mixing.SLOTS)))
    vectors = mixing.stored(table.mapInArrow(fit.vectors, "own binary, sizes binary, off binary, slots binary, values binary"))
    rows = vectors.coalesce(1).mapInArrow(fit.by_centre, "key long, " + ", ".join(f"n{i} long" for i in range(12)))
    assert rows.count() <= 500 + 2


def test_first_centres_take_few_passes_and_are_those_of_a_pass_each(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices([f"{r.choice('abc')}{j}" for j in range(40 * (i % 12), 40 * (i % 12) + 60)], k=r.randint(1, 30))), r.choice(["en", "fr"])) for i in range(900)]
    df = spark.createDataFrame(rows + [(i + 900, *x) for i, *x in rows[:300]], "doc_id long, text string, lang string").repartition(5)
    passes, least = [], mixing.least
    monkeypatch.setattr(mixing, "least", lambda *a: passes.append(a[1].__name__) or least(*a))
    few = mixing.learn_topics(df, rounds=0)
    assert (n := passes.count("farthest")) < 8
    monkeypatch.setattr(mixing, "AHEAD", 1)
    each = mixing.learn_topics(df, rounds=0)
    assert passes.count("farthest") - n == 11
    assert len(few.centres) == 12 and (few.centres == each.centres).all()


def test_the_tables_of_the_fit_take_a_byte_a_count(spark):
    counts = np.array([1, 2, 254, 255, 256, 70_000, 1])
    assert (mixing.logs_of(mixing.in_bytes(counts), len(counts)) == np.log1p(counts).astype(np.float32)).all()
    table = mixing.features(docs(spark, [(i, "a b b c " * (1 + 200 * (i == 5))) for i in range(50)]).coalesce(1), "text", "lang")
    fit = mixing.Fit({"en": 0}, np.ones(mixing.SLOTS), np.zeros((2, mixing.SLOTS)), np.zeros((1, mixing.SLOTS)))
    row = table.mapInArrow(fit.vectors, "own binary, sizes binary, off binary, slots binary, values binary").first()
    assert len(row["slots"]) == 2 * 150 and len(row["values"]) == 150 + 4  # one of 402 words b
    whole = next(fit.known(iter([pa.RecordBatch.from_arrays([pa.array([bytes(row[x])]) for x in mixing.VECTORS], [*mixing.VECTORS])])))
    own = np.split(whole[4], 50)
    assert all(np.linalg.norm(x) == pytest.approx(1, abs=1e-6) for x in own) and sorted(own[5] / own[5].min())[-1] == pytest.approx(np.log(403) / np.log(202), rel=1e-5)


def test_cells_fitted_as_arrays_and_as_a_table_agree(spark, monkeypatch):
    r = random.Random(9)
    cells = spark.createDataFrame([(s, x, t, r.choice([0, 1, 10, 500])) for s in "abcd" for x in ("en", "de", "fr") for t in ("t1", "t2")], "source string, lang string, topic string, n_tokens long")
    targets = {"source": {"a": 1, "b": 2, "z": 5}, "lang": {"en": 3, "fr": 1}}
    few = mixing.rake(cells, targets).toPandas().sort_values(["source", "lang", "topic"])
    monkeypatch.setattr(mixing, "CELLS", 0)
    many = mixing.rake(cells, targets).toPandas().sort_values(["source", "lang", "topic"])
    assert list(few.columns) == list(many.columns) and len(few) == len(many) == 24
    for c in ("weight", "error", "want_source", "want_lang", "want_topic"):
        assert np.allclose(few[c], many[c], rtol=1e-9, atol=1e-12), c
    assert mixing.rake(cells.limit(0)).count() == 0
    monkeypatch.undo()
    assert mixing.rake(cells.limit(0)).count() == 0


def test_mixing_edge_cases(spark):
    odd = docs(spark).withColumns({"topic": F.lit("x"), "Weight": F.lit(1)})
    assert mixing.decide(odd).count() == 6
    assert mixing.decide(docs(spark, [])).count() == 0
    assert mixing.decide(docs(spark, [(1, None), (2, "")])).count() == 2


# fingerprints


def test_merkle_roots_and_likeness(spark):
    a = "one two three four five six seven eight nine ten\nnext line\n\nsection two is here"
    rows = [(1, a), (2, a), (3, a.replace("nine", "NINE")), (4, None), (5, "")]
    found = {r.doc_id: r for r in merkle.fingerprint_edits(docs(spark, rows)).collect()}
    assert found[1].fingerprint == found[2].fingerprint != found[3].fingerprint
    assert found[4].fingerprint == found[5].fingerprint
    assert (found[1].near_next, found[4].near_next) == (1.0, 1.0)
    assert found[2].near_next == pytest.approx(0.75)  # three of four leaves
    assert found[1].edited_fingerprint == found[1].fingerprint or found[1].near_edited < 1
    strings = spark.createDataFrame([(found[2].fingerprint, found[3].fingerprint)], "a string, b string")
    assert strings.select(merkle.likeness_of_strings(F.col("a"), F.col("b")).alias("x")).first().x == pytest.approx(0.75)
    # the branches that differ locate the edit: first section, first paragraph, second leaf
    leaf = lambda s: [p.split(".")[1:] for p in s.split("|")[1].split("/")[1:]]
    x, y = leaf(found[2].fingerprint), leaf(found[3].fingerprint)
    assert [(i, j) for i in range(2) for j in range(len(x[i])) if x[i][j] != y[i][j]] == [(0, 1)]


def test_the_next_document_over_ranges(spark):
    r = random.Random(8)
    ids = sorted(r.sample(range(10**9), 40)) + [10**12, 10**15]
    found = {x.doc_id: x.next_value for x in merkle.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, t string"), "doc_id", "t").collect()}
    assert found == {i: f"t{j}" for i, j in zip(ids, [*ids[1:], ids[0]], strict=True)}
    assert merkle.fingerprint_edits(docs(spark)).count() == 6
    assert merkle.fingerprint_edits(docs(spark, [])).count() == 0
    assert merkle.fingerprint_edits(docs(spark, [(5, "alone here")])).first().near_next == 1.0


# URL filters


def test_url_rules_by_brute_force(spark):
    r = random.Random(2)
    hosts = ["example.org", "www.example.org", "a.example.com", "org", "notexample.org", "x.net", "EXAMPLE.com"]
    urls = [r.choice(["http", "ftp"]) + "://" + r.choice(hosts) + r.choice(["", "/", "/es/", "/en/17", "/fr/x", "/de/", "/es?x", "#f"]) for _ in range(200)] + [None, "", "no scheme", "://", "a://b://org/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for x in url_filter.judge_urls(pages, url_filter.RULES).collect():
        rest = x.url.split("://", 1)[1] if x.url and "://" in x.url else ""
        host = rest.split("#")[0].split("?")[0].split("/")[0].lower()
        tail = rest[len(host) :].split("#")[0].split("?")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and tail.startswith(p)]
        assert (x.host, x.path) == (host, tail)
        assert (x.rule, x.verdict) == (max(fits)[1:] if fits else (None, "allow"))
    table = spark.createDataFrame([*url_filter.RULES, ("allow", "Example.org", "/es/")], "verdict string, host string, path string")
    assert sorted(map(str, url_filter.judge_urls(pages, table).collect())) == sorted(map(str, url_filter.judge_urls(pages, url_filter.RULES).collect()))
    with pytest.raises(ValueError, match="verdict must be"):
        url_filter.judge_urls(pages, table.withColumn("verdict", F.lit("maybe")))
    assert url_filter.judge_urls(pages.limit(0), url_filter.RULES).count() == 0
    assert {x.verdict for x in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_headings_that_all_articles_of_a_host_share_stay(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Dish {i}</h1><h2>Ingredients</h2><p>{i} eggs and flour {i}</p><h2>Method</h2><p>Stir it {i} times.</p></article><footer>Imprint</footer></body></html>"
    df = spark.createDataFrame([(i, f"http://h.org/{i}", page.format(i=i)) for i in range(10)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_wrapper.extract(df).collect()}
    assert found == {i: f"Dish {i}\nIngredients\n{i} eggs and flour {i}\nMethod\nStir it {i} times." for i in range(10)}


def test_the_budget_is_met_whatever_the_spread_of_rates(spark):
    # each step caps few cells of rates that double from one to the next: far more steps than a fixed number would allow for
    cells = [("s", "l", str(k), 1 if k < 150 else 1 << (k // 8), 2.0**-k) for k in range(200)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, n_tokens long, weight double")
    for share in (0.001, 0.5, 0.999):
        found = mixing.calibrate(df, share).toPandas()
        tokens, rate = found.n_tokens.astype(float), found.weight / found.n_tokens
        assert (found.probability * tokens).sum() == pytest.approx(share * tokens.sum(), rel=1e-9)
        free = found.probability < 1
        factor = found.probability[free] / rate[free]
        assert factor.min() == pytest.approx(factor.max()) and (rate[~free] * factor.max() >= 1 - 1e-9).all()
    none = df.withColumn("weight", F.lit(0.0))
    assert set(mixing.calibrate(none).toPandas().probability) == {0.0} and mixing.calibrate(df.limit(0)).count() == 0
