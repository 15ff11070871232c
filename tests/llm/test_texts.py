"""Decontamination, language identification and tokens."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import sentencepiece
from gridgraph.llm import decontaminate, language_id, sentencepiece_codec
from pyspark.sql import functions as F


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_report(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def leaky(seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "été", "x1", *[f"w{i}" for i in range(30)]]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 13, 14, 30])))) for k in range(12)]
    items += [(12, None), (13, "..."), (None, "a null id here"), (3, "one id again with another text of its own which is longer than the window")]
    docs = []
    for d in range(80):
        w = [rng.choice([*vocabulary, "other", "words"]) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.choice([0, 1, 2])):
            i = words(rng.choice(items)[1])
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if x.isascii() else x for x in i[rng.randint(0, 1) :]]
        docs.append((d, rng.choice([" ", "; ", "\n"]).join(w)))
    return [*docs, (100, None), (101, ""), (102, "!?"), (103, "the of " * 9000), (103, "the of " * 9000)], items


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_report(spark, block_bytes):
    docs, items = leaky()
    d = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id bigint, text string, n_words int").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, decontaminate.report(d, b, block_bytes=block_bytes).collect()), key=str) == brute_report(docs, items)


def test_clean(spark):
    docs, items = leaky(2)
    d = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id bigint, text string, spans int").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.clean(d, b)
    told = {r[0]: r for r in brute_report(docs, items)}
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in docs if not told[i][5])
    texts = dict(docs)
    for r in out.collect():
        assert len(words(r.text)) == told[r.doc_id][1] - told[r.doc_id][2] and (told[r.doc_id][2] or r.text == texts[r.doc_id])
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.report(d, none).filter("n_hit > 0").isEmpty() and decontaminate.report(d.limit(0), b).isEmpty()


def test_index_against_plain_search():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 3000):
        text = np.append(rng.integers(0, 4, n), 0)
        order = decontaminate.suffix_array(text)
        suffixes = [tuple(text[i:]) for i in range(len(text))] if n < 100 else None
        assert suffixes is None or order.tolist() == sorted(range(len(text)), key=lambda i: suffixes[i])
        index = decontaminate.FMIndex(text, 4)
        for m in (1, 2, 5):
            patterns = rng.integers(1, 4, (20, m))
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi, strict=True):
                want = [i for i in range(len(text) - m + 1) if (text[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    same = decontaminate.suffix_array(np.zeros(500, np.int64))
    assert same.tolist() == list(range(499, -1, -1))


def test_codewords():
    for n in (2, 3, 4, 6, 9):
        code = language_id.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + 99 * np.eye(n)
        assert apart.min() >= 2 ** (n - 2) if n <= 6 else apart.min() >= 10
        assert (np.abs(code.sum(axis=0)) < n).all()  # no bit is the same for all
    assert language_id.codewords(1).shape == (1, 0)


def speech(rng, lang):
    parts = {"aa": ["the", "ing", "and", "wh"], "bb": ["der", "ung", "sch", "ö"], "cc": ["ción", "ado", "que", "ñ"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))


def spoken(n=150):
    rng = random.Random(8)
    return [(d, speech(rng, "abc"[d % 3] * 2), "abc"[d % 3] * 2) for d in range(n)]


def test_languages(spark):
    rows = spoken() + [(900, None, "aa"), (901, "", None), (902, "12 !?", "bb"), (903, "the and ing " * 40000, None), (None, "der ung sch", "bb")]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id bigint, text string, lang string, lang_pred string").repartition(3)
    model = language_id.fit(docs.filter(language_id.fold() > 0), "text", "lang", 60)
    told = language_id.predict(docs, model)
    assert sorted(told.columns) == sorted(["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"])
    got = {r.doc_id: r for r in told.collect()}
    assert np.mean([got[d].lang_pred == lang for d, _, lang in rows[:150]]) > 0.97
    assert {got[d].lang_pred for d in (900, 901, 902)} == {"und"} and got[903].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == 0
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & {900, 901, 902} == set()


def test_the_sample_is_determined(spark):
    """The same texts are learned whatever the order and number of copies of rows."""
    rows = spoken(120)
    more = [(1000 + k, rows[0][1], "aa") for k in range(400)] + [(2000 + k, rows[1][1], "bb") for k in range(300)]
    schema = "doc_id bigint, text string, lang string"
    a = spark.createDataFrame([*rows, *more], schema).repartition(5)
    b = spark.createDataFrame([*more[::-1], *rows[::-1]], schema).repartition(2)
    first, second = (language_id.fit(x, "text", "lang", 30) for x in (a, b))
    assert first.languages == second.languages == ["aa", "bb", "cc"] and (first.weights == second.weights).all() and (first.trust == second.trust).all()
    # Ten different texts of each language, however many copies one has.
    chosen = language_id._chosen(a.select(F.col("lang").alias("l"), F.xxhash64("text").alias("h")), {"aa": 1, "bb": 1, "cc": 1}, 10)
    assert len(set(chosen)) == 30 and {k: sum(c[0] == k for c in chosen) for k in ("aa", "bb", "cc")} == {"aa": 10, "bb": 10, "cc": 10}


def test_decoding_by_plain_loops(spark):
    """Features, margins and loss-weighted decoding again, one number at a time."""
    rows = spoken(60)
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "text", "lang", 45)
    docs = spark.createDataFrame([(d, t) for d, t, _ in spoken(90)], "doc_id bigint, text string")
    for r in language_id.predict(docs, model).collect():
        plain = (" " + r.text.lower() + " ").encode()
        plain = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in plain)
        counts = {}
        for i in range(len(plain) - 2):
            a, b, c = plain[i : i + 3]
            if b != 32:
                h = (((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) & 0xFFFFFFFF) >> (32 - language_id.BITS)
                counts[h] = counts.get(h, 0) + 1
        total = sum(counts.values())
        losses = []
        for lang in range(3):
            loss = 0.0
            for bit in range(model.code.shape[1]):
                margin = model.bias[bit] + sum(model.weights[h, bit] * math.sqrt(n / total) for h, n in counts.items())
                loss += model.trust[lang, bit] * math.log1p(math.exp(-margin * model.code[lang, bit]))
            losses.append(loss)
        assert r.lang_pred == model.languages[losses.index(min(losses))]
        share = 1 / sum(math.exp(-model.code.shape[1] * (x - min(losses))) for x in losses)
        assert abs(share - r.score) < 1e-3
    # Equal losses go to the first language by name.
    tie = language_id.Model(["bb", "cc"], np.eye(2, 1 << language_id.BITS, dtype=np.float32), np.array([0, 1]))
    tie.weights[:] = tie.bias[:] = 0
    tie.trust[:] = 1
    assert tie.predict(np.zeros((1, 1 << language_id.BITS), np.float32))[0].tolist() == [0]


def test_odd_languages(spark):
    schema = "doc_id bigint, text string, lang string"
    empty = spark.createDataFrame([], schema)
    assert language_id.keep_known(empty).isEmpty()
    nothing = language_id.fit(empty, "text", "lang")
    docs = spark.createDataFrame([(1, "text", None), (2, "text", "aa")], schema)
    assert [r.lang_pred for r in language_id.predict(docs, nothing).collect()] == ["und", "und"]
    one = language_id.fit(docs, "text", "lang")
    assert [(r.lang_pred, r.score) for r in language_id.predict(docs, one).collect()] == [("aa", 1.0)] * 2


def test_held_out_accuracy(spark):
    from pathlib import Path

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("the tables are not here")
    told = language_id.op4_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert told.filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.default_model()


@pytest.fixture(scope="module")
def codec(model):
    return sentencepiece_codec.Codec(open(model, "rb").read())


@pytest.fixture(scope="module")
def lib(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


def test_codec_equals_the_library(codec, lib):
    rng = random.Random(2)
    letters = "aaabetinhos the  , .\n\té▁日𠮷\x00ñABC<s>/[]()=-_01239'\"ß\xa0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "▁", "a" * 3000, "ab" * 2000, " " * 500, "=" * 333 + "\n" * 50, "<s>hi</s>", "\ufffd", "ﬁ½"]
    for t in texts:
        ids = codec.encode(t)
        assert ids == lib.encode(t, add_eos=True)
        assert codec.decode(ids) == lib.decode(ids)


def test_decoding_of_any_ids(codec, lib):
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 3 + rng.choice([0xE6, 0x97, 0xA5, 0xC3, 0xA9])]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == lib.decode(ids)


def test_tables_stay_bounded(codec, lib, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CHUNKS", 20)
    monkeypatch.setattr(sentencepiece_codec, "PAIRS", 20)
    rng = random.Random(4)
    for _ in range(300):
        t = " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(9))
        assert codec.encode(t) == lib.encode(t, add_eos=True)
    assert len(codec.pairs) <= 20 and len(codec.chunks) <= 20


def test_encoding_of_tables(spark, model, lib):
    rows = [(1, "some text", 5), (1, "some text", 5), (2, None, 5), (3, "", 5), (4, "x" * 50000, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    for r in sentencepiece_codec.encode(docs, model).collect():
        want = lib.encode(r.text or "", add_eos=True)
        assert (r.ids, r.n_tokens) == (want, len(want))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()
    few = sentencepiece_codec.encode(docs, model, ids=False)
    assert few.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and few.count() == 5
    assert sentencepiece_codec.encode(docs.limit(0), model).isEmpty()
