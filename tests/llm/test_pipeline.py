"""The pipeline against its stages by brute force, and the queries against their SQL."""

import hashlib
import math
import random
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import sentencepiece
from gridgraph.llm import language_id, line_dedup, sentencepiece_codec
from gridgraph.llm.queries import ORACLE_SQL, QUERIES

from tests.llm.test_pairs import brute_documents, brute_lines, copies
from tests.llm.test_texts import brute_report, speech, words

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(12)
    langs = ["aa", "bb", "cc"]
    rows = []
    for d in range(120):
        lang = langs[d % 3]
        rows.append((d, "\n".join(speech(rng, lang) for _ in range(rng.randint(1, 4))), lang))
    items = [(k, " ".join(f"q{k}x{j}" for j in range(20))) for k in range(5)]
    for d in range(200, 240):
        base = rows[d % 30]
        kind = d % 4
        text = {0: base[1], 1: base[1] + " one more word", 2: items[d % 5][1] + "\n" + speech(rng, base[2]), 3: (base[1] + " ") * 8 + items[d % 5][1]}[kind]
        rows.append((d, text, base[2]))
    rows += [(300, None, "aa"), (301, "", None), (302, "?! 12", "bb")]
    path = str(tmp_path / "sf")
    spark.createDataFrame([(d, t, lang, "s", 0) for d, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_pipeline(spark, corpus):
    path, rows, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = language_id.fit(docs.filter(language_id.fold() > 0), "text", "lang")
    xs = {d: language_id.features(t.encode() if t else None) for d, t, _ in rows}
    left = [(d, t) for d, t, _ in rows if xs[d] is not None and model.predict(np.array([xs[d]]))[1][0] >= language_id.CERTAIN]
    told = brute_lines(left)
    gone, copied = {(r[0], r[1]) for r in told if not r[5]}, copies(left, told)
    kept = []
    for d, t in left:
        if d in copied:
            continue
        lines = [x for k, x in enumerate(t.split("\n")) if (d, k) not in gone]
        if lines:
            kept.append((d, "\n".join(lines)))
    one = {r[1] for r in brute_documents(kept)}
    kept = [(d, t) for d, t in kept if d in one]
    told = {r[0]: r for r in brute_report(kept, items)}
    want = {d: t for d, t in kept if not told[d][5]}
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(want) and 60 < len(got) < 160
    for d, r in got.items():
        text = lib.decode(r.ids)
        assert len(words(text)) == told[d][1] - told[d][2] and r.n_chars == len(text)
        if not told[d][2]:
            assert text == want[d] and r.ids == lib.encode(text, add_eos=True)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert any(r[2] for r in told.values()) and any(r[5] for r in told.values())


def brute_short_lines(rows):
    """Lines that are too short for the edit join: one where they are equal."""
    found = [(d, k, x) for d, t in rows if t is not None for k, x in enumerate(t.split("\n")) if len(x) < line_dedup.LEAST]
    first = {}
    for d, k, x in found:
        first[x] = min(first.get(x, (d, k)), (d, k))
    return [(d, k, *first[x], 0, (d, k) == first[x]) for d, k, x in found]


def test_registered_queries(spark, corpus, tmp_path):
    """The queries that no SQL expresses, as they are registered, over whole tables."""
    path, rows, _ = corpus
    texts = [(d, t) for d, t, _ in rows]
    told = {n: sorted(map(tuple, QUERIES[n](spark, path).collect())) for n in ("op3_line_dedup", "op5_sentencepiece", "op7_ngram_join")}
    assert told["op3_line_dedup"] == sorted([*brute_lines(texts), *brute_short_lines(texts)])
    assert told["op7_ngram_join"] == brute_documents(texts)
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    want = []
    for d, t in texts:
        ids = lib.encode(t or "", add_eos=True)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert told["op5_sentencepiece"] == sorted(want)
    pages = [(1, "<p>one<p>two"), (2, None), (3, "<table><tr><td>a<td>b</table>"), (3, "x")]
    spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "p" / "pages.parquet"))
    found = sorted(tuple(r) for r in QUERIES["op8_html"](spark, str(tmp_path / "p")).select("page_id", "text", "n_chars", "n_lines").collect())
    assert found == [(1, "one\n\ntwo", 8, 3), (2, "", 0, 0), (3, "a  b", 4, 1), (3, "x", 1, 1)]


def test_stages_keep_the_columns(spark, corpus):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).isEmpty()


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*names).collect())
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for f in Path(DATA).iterdir():
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        found = con.execute(ORACLE_SQL[name])
        told = [c[0] for c in found.description]
        at = [told.index(n) for n in names]
        assert sorted(told) == names and got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
