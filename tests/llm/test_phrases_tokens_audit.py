"""Collocations, byte-level BPE and the filter audit against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter
from itertools import pairwise, permutations

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from clickweave.llm import byte_bpe, collocations, filter_audit

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


# collocations


def phrases_by_hand(rows, least, longest, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    found = []
    for lang, f in counts.items():
        kept = []
        frequent = {p: a for p, a in f.items() if a >= least}
        around = {}
        for q, a in frequent.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    around[q[i : i + k]] = max(around.get(q[i : i + k], 0), a)
        for p, a in frequent.items():
            if len(p) > 1 and around.get(p, 0) < a:
                score, _, l, r = min((1000 * a * totals[lang] // (f[p[:c]] * f[p[c:]]), c, f[p[:c]], f[p[c:]]) for c in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        found += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], totals[lang], -x[0]) for i, x in enumerate(sorted(kept)[:top])]
    return sorted(found)


@pytest.mark.parametrize("buckets", [1 << 10, 1 << 20])
def test_collocations_are_those_of_a_full_count(spark, monkeypatch, buckets):
    rng = random.Random(5)
    words = ["New", "york", "city", "hall", "is", "the", "of", "Ünder", "\U0001f600", "x y"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(words[: rng.choice([4, 10])]) + rng.choice(["", "", "", ".", ",\t", "\n"]) for _ in range(rng.randrange(300)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), ("fr", "."), ("en", "new york city hall " * 500), ("de", "ab " * 900 + "!")]
    monkeypatch.setattr(collocations, "SLICE", 70)  # workers import the module anew; the slices themselves are tested below
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    found = sorted(tuple(r) for r in collocations.collocations(df, least=7, top=40, buckets=buckets).collect())
    assert found == phrases_by_hand(rows, 7, 5, 40)
    assert any(r[1] == 40 for r in found)
    assert collocations.collocations(df.limit(0)).count() == 0
    more = collocations.collocations(df.selectExpr("lang AS l", "text AS phrase", "1 AS h", "2 AS n", "3 AS bucket"), "phrase", "l", 7, top=40, buckets=buckets)
    assert sorted(tuple(r) for r in more.collect()) == found


def test_words_hashed_at_once_are_those_split_one_by_one(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 5)
    texts = [b"Ab  cd,ef\tgh. ab cd\xc3\xa9 ef " * 7, b"", b" ,, ", b"one", b"x" * 40 + b" y z. q", b"a b c d e f g h i j k l m"]
    block, want = collocations.Hashed(), []
    for i, text in enumerate(texts):
        lang = ("en", "fr")[i % 2]
        for part, own in collocations.slices(text, 3):
            block.add(lang, part, own)
        for piece in text.lower().translate(collocations.PLAIN).split(collocations.END):
            w = piece.split()
            want += [(lang, b" ".join(w[j : j + 3])) for j in range(len(w) - 2)]
    block.close()
    whole = np.flatnonzero((block.piece[:-2] == block.piece[2:]) & block.own[:-2])
    assert sorted((block.langs[block.of[i]], block.phrase(i, 3)) for i in whole) == sorted(want)
    # the first pass has the same hashes; words of one hash are told apart
    known = collocations.Block()
    known.known += [(block.langs[block.of[i]], block.text[block.start[i] : block.stop[i]]) for i in range(len(block.word))]
    known.numbers = {"en": {}, "fr": {}}
    assert (known.hashes()[1:] == block.word).all()
    kinds = len(set(known.known[1:]))
    every = np.arange(len(block.word))
    assert len(set(block.numbers(every, 1).tolist())) == kinds
    block.word = np.zeros_like(block.word)
    assert len(set(block.numbers(every, 1).tolist())) == kinds


def test_slices_lose_and_double_nothing(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 5)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab  .c\t") for _ in range(rng.randrange(80))).encode()
        whole, starts = [], Counter()
        for found, own in collocations.words(text, 3):
            starts.update(tuple(found[i : i + 3]) for i in range(own))
            whole += found[:own]
        flat = text.translate(collocations.PLAIN).replace(b"\xff", b" \xff ").split()
        assert whole == flat
        assert starts == Counter(tuple(flat[i : i + 3]) for i in range(len(flat)))


def test_phrases_of_one_hash_are_told_apart():
    w = np.array([1, 2, 1, 3, 1, 2, 0])
    first, n = collocations.distinct(np.zeros(7, np.uint64), np.array([0, 2, 4]), w, 2)
    assert sorted(zip(w[first + 1].tolist(), n.tolist(), strict=True)) == [(2, 2), (3, 1)]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000_007
    found = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 5), ("en", "b", 1, big + 9)], "lang string, phrase string, k int, a long")
    totals = spark.createDataFrame([("en", 10**17)], "lang string, n long")
    row = collocations.scored(found, totals).first()
    assert row.score == 1000 * big * 10**17 // ((big + 5) * (big + 9))


# byte-level BPE


@pytest.fixture(scope="module")
def both():
    own = byte_bpe.Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


TEXT = st.lists(st.sampled_from(["a", "b", "'", "ll", "re", " ", "  ", "\n", "\t", "1", "23", ".", "é", "漢字", "\U0001f600", "　", "the", "aaaa", "́", "\x1c", "\x85"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 6), st.integers(2, 9))
def test_joins_of_any_cut_give_the_library_s_ids(both, text, leaf, leaf_bytes):
    own, library = both
    kept = byte_bpe.LEAF, byte_bpe.WINDOW, own.leaf_bytes
    byte_bpe.LEAF, byte_bpe.WINDOW, own.leaf_bytes = leaf, 2, leaf_bytes
    try:
        found = own.encode(text)
        ids = found.ids.tolist()
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
        assert found.sizes.sum() == len(ids)
        assert [text[a:b] for a, b in pairwise([*found.starts, len(text)])] == own.pattern.findall(text)
    finally:
        byte_bpe.LEAF, byte_bpe.WINDOW, own.leaf_bytes = kept


def test_long_matches_and_texts(both):
    own, library = both
    rng = random.Random(3)
    for text in ("".join(rng.choice("thering") for _ in range(9000)), "漢字中文" * 900, " " * 7001 + "x", "'l" + "l" * 5000, "word " * 5000, "ab1!" * 2000):
        assert own.encode(text).ids.tolist() == library.encode_ordinary(text)
    assert all(own.merged_long(b) == own.merged_short(b) == [i] for b, i in list(own.ranks.items())[::50])


def test_every_code_point_is_matched_alike(both):
    own, library = both
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 5000):
        text = "".join(f"a{c}b 1{c}{c} {c}x" for c in points[i : i + 5000])
        assert own.encode(text).ids.tolist() == library.encode_ordinary(text)


def test_tokenized_tables(spark, both):
    texts = [None, "", "a", "Hello world", "Hello world", "\U0001f600 é", "x" * 5000]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)], "doc_id long, text string, token_ids int, data string")
    found = byte_bpe.tokenize(df, PATH)
    assert found.columns == ["doc_id", "text", "data", "token_ids"]
    rows = found.select("doc_id", "token_ids", byte_bpe.decoded(spark, found.token_ids, PATH).alias("back")).orderBy("doc_id").collect()
    assert [list(r.token_ids) for r in rows] == [both[1].encode_ordinary(t or "") for t in texts]
    assert [bytes(r.back).decode() for r in rows] == [t or "" for t in texts]
    assert byte_bpe.tokenize(df.limit(0), PATH).count() == 0


# the filter audit


def audit_by_hand(docs, labels):
    first, tags, rows = {}, {}, []
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        old = tags.get(i, (False, False))
        tags[i] = (old[0] or q == 1, old[1] or x == 1)
    for i, t, s in docs:
        t = t or ""
        w = re.findall("[^ \t-\r]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((s or "", fails, *(tags.get(i, (False, False)) if i is not None else (False, False))))
    found, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[part, f] += len(gone)
                found.append([part, order, step + 1, len(left), len(gone), sum(r[1][f] for r in own) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in found)


def test_the_audit_counts_every_order(spark):
    rng = random.Random(4)
    texts = [None, "", "UPPER CASE", "a # b", "\U0001f600" * 20 + "A", "\x0b\x0c x\x85y", *[" ".join(str(rng.randrange(90)) for _ in range(rng.choice([30, 60, 90]))) + rng.choice(["", "$", "ABCDEFGHIJKLMNOPQRST"]) for _ in range(40)]]
    docs = [(rng.choice([None, *range(200)]) if i % 9 == 0 else i, rng.choice(texts), rng.choice([None, "", "s1", "s2", "s2", "s2"])) for i in range(700)]
    labels = [(rng.randrange(700), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(400)] + [(None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = filter_audit.audit(df, tags)
    assert found.columns == columns
    want = audit_by_hand(docs, labels)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert filter_audit.audit(df.limit(0), tags).count() == 0
    named = df.selectExpr("doc_id AS id", "text AS part", "source AS digest", "1 AS A", "2 AS first")
    assert sorted(tuple(r) for r in filter_audit.audit(named, tags.withColumnRenamed("doc_id", "id"), "id", "part", "digest").collect()) == want


def test_many_parts_fill_words_of_their_own():
    rows = pd.DataFrame({"part": [f"p{i % 9000}" for i in range(20000)], "A": [i % 3 == 0 for i in range(20000)], "good": [i % 7 == 0 for i in range(20000)]})
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pandas(rows[i : i + 6000]) for i in range(0, 20000, 6000)]
    found = pd.concat([b.to_pandas() for b in filter_audit.tallies("A", ["good"])(iter(batches))]).groupby(["part", "subset"]).sum()
    assert len(found) == 18000
    for p in ("p0", "p8999", "p63"):
        own = rows[rows.part == p]
        assert found.loc[p, 0].tolist() == [len(own), own.good.sum()]
        assert found.loc[p, 1].tolist() == [(~own.A).sum(), (own.good & ~own.A).sum()]


def test_digests_of_ids_and_bytes(spark, both):
    import __spark_entry__

    found = __spark_entry__.queries()["op12_byte_bpe"](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    assert len(found) == len(docs)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = both[1].encode_ordinary(t or "")
        assert found.loc[i].n_tokens == len(ids)
        assert found.loc[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found.loc[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_a_task_gives_one_row_for_sixteen_buckets():
    texts = [" ".join(f"w{(i * j) % 5000}" for j in range(300)).encode() + b". End" for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 200), pa.array(texts, pa.binary())], ["lang", "text"])
    none = np.zeros(0, np.uint8)
    out = pa.Table.from_batches(collocations.counted(1, 5, 1 << 10, 3, lambda: none, lambda: none)(iter([batch])))
    buckets = out.filter(pc.is_valid(out["bucket"]))
    assert buckets.num_rows == 64  # of 1,024 buckets
    words = Counter(w for t in texts for w in t.lower().replace(b".", b"").split())
    named = out.filter(pc.is_valid(out["h"]))
    assert dict(zip(named["phrase"].to_pylist(), named["n"].to_pylist(), strict=True)) == words and set(named["lang"].to_pylist()) == {"en"}
    lanes = np.stack([buckets[x].to_numpy() for x in collocations.LANES], 1)[np.argsort(buckets["bucket"].to_numpy())]
    tally = np.stack([lanes & (1 << 31) - 1, lanes >> 31], 2).ravel()
    block = collocations.Hashed()
    for t in texts:
        block.add("en", t.lower().translate(collocations.PLAIN), len(t))
    block.close()
    pairs = collocations.longer(block.word, block.word, 2)[block.piece[:-1] == block.piece[1:]]
    assert (tally == np.minimum(np.bincount((pairs & np.uint64(1023)).astype(int), minlength=1024), 3)).all()
