"""Line dedup and the n-gram join against brute force, and their parts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from gridgraph.llm import bucket_join, line_dedup, ngram_join
from gridgraph.llm.common import words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


def groups(items, linked):
    root = {i: i for i in items}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for n, i in enumerate(items):
        for j in items[:n]:
            if linked(i, j):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    return top, links


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance_and_probes(threshold):
    rng = random.Random(threshold)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        near = distance(a, b) <= threshold
        assert line_dedup.within(a, b, threshold) == near
        if near and min(len(a), len(b)) > threshold:
            short, long = sorted((a, b), key=len)
            indexed = {(len(short), k, short[x : x + n]) for k, (x, n) in enumerate(line_dedup.segments(len(short), threshold))}
            assert indexed & {(n, k, long[x : x + s]) for n, k, x, s in line_dedup.probes(len(long), threshold)}


def line_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(24, 40))) for _ in range(25)]
    rows = []
    for d in range(50):
        lines = []
        for _ in range(rng.randint(0, 5)):
            b = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(b))
                b[at : at + 1] = rng.choice(["", "x", "yz"])
            lines.append("".join(b))
        rows.append((d, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (102, "short"), (103, "\n\n"), (104, base[0] + "\n" + base[0]), (105, "long " * 3000)]


def brute_lines(rows):
    first, found = {}, []
    for d, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if len(x) >= line_dedup.LEAST:
                found.append((d, k, x))
                first[x] = min(first.get(x, (d, k)), (d, k))
    top, links = groups(list(first), lambda a, b: abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2)
    least = {}
    for x in first:
        least[top(x)] = min(least.get(top(x), first[x]), first[x])
    return sorted((d, k, *least[top(x)], links[x], (d, k) == least[top(x)]) for d, k, x in found)


def test_parity_keeps_near_lines():
    rng = random.Random(1)
    for _ in range(2000):
        a = "".join(rng.choice("abé日") for _ in range(rng.randint(0, 30)))
        b = list(a)
        edits = rng.randint(0, 3)
        for _ in range(edits):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        x, y, _ = line_dedup.bigram_parity([a, "".join(b), "other"])
        assert int(x ^ y).bit_count() <= 4 * edits


@pytest.mark.parametrize("block", [2, 256])
def test_line_classes(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "HOT", block)
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(map(tuple, line_dedup.line_classes(docs).collect())) == brute_lines(rows)


def copies(rows, told):
    """Documents of which four fifths stand first in one other document."""
    texts, same = dict(rows), Counter()
    for d, k, class_d, *_, keep in told:
        if not keep and class_d != d:
            same[d, class_d] += len(texts[d].split("\n")[k])
    return {d for (d, _), n in same.items() if n >= line_dedup.COPY * len(texts[d].replace("\n", ""))}


def test_changed_copies_go_whole(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(40)]
    rows = [(1, "\n".join(lines[:10])), (2, "\n".join([*lines[:9], lines[20]])), (3, "\n".join([*lines[:5], *lines[21:25]])), (4, "\n".join(lines[25:27] * 9 + lines[27:29])), (5, "\n".join([*lines[1:5], *lines[21:24], lines[30], lines[31]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    # The fourth repeats itself, the fifth two documents: these lose lines and stay.
    assert out == {1: rows[0][1], 3: "\n".join(lines[21:25]), 4: "\n".join(lines[25:29]), 5: "\n".join(lines[30:32])}
    assert 2 in {r.doc_id for r in line_dedup.drop_repeated_lines(docs, copy=0.95).collect()}


def test_repeated_lines_go(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, keep string, line_no int").repartition(3)
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    told = brute_lines(rows)
    gone, copied = {(r[0], r[1]) for r in told if not r[5]}, copies(rows, told)
    want = {}
    for d, t in rows:
        if d in copied:
            continue
        lines = [x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone]
        if t is None or lines:
            want[d] = None if t is None else "\n".join(lines)
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_lines_of_odd_tables(spark):
    schema = "doc_id bigint, text string"
    line = "a line that is long enough to count"
    empty = spark.createDataFrame([], schema)
    assert line_dedup.line_classes(empty).isEmpty() and line_dedup.drop_repeated_lines(empty).isEmpty()
    # A null id stands first; rows that repeat a document keep the same lines.
    docs = spark.createDataFrame([(None, line), (1, line), (2, line + "!"), (2, line + "!")], schema)
    assert {(r.doc_id, r.class_doc_id, r.n_links, r.keep) for r in line_dedup.line_classes(docs).collect()} == {(None, None, 1, True), (1, None, 1, False), (2, None, 1, False)}
    twice = spark.createDataFrame([(2, line), (2, line)], schema)
    assert [r.keep for r in line_dedup.line_classes(twice).collect()] == [True, True]


def test_short_lines_have_classes(spark, monkeypatch):
    rows = [(1, "Les.\nOf, edti oner.\n"), (2, "Les.\nLes!"), (3, "Of, edti oner.\n\na line that is long enough to count"), (4, "a line that is long enough to coumt\né"), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = {
        (1, 0, 1, 0, 0, True), (1, 1, 1, 1, 0, True), (1, 2, 1, 2, 0, True), (2, 0, 1, 0, 0, False), (2, 1, 2, 1, 0, True),
        (3, 0, 1, 1, 0, False), (3, 1, 1, 2, 0, False), (3, 2, 3, 2, 1, True), (4, 0, 3, 2, 1, False), (4, 1, 4, 1, 0, True), (5, 0, 1, 2, 0, False),
    }
    assert set(map(tuple, line_dedup.line_classes(docs, short=True).collect())) == want
    monkeypatch.setattr(line_dedup, "table", lambda *_: docs)
    assert set(map(tuple, line_dedup.op3_line_dedup(spark, "").collect())) == want


def test_copies_leave_no_stubs(spark):
    line = "a line that is long enough to count"
    rows = [(1, f"Haanth.\n\n{line}\n"), (2, f"Haanth.\n\n{line}\n"), (3, f"{line}\n"), (4, "Haanth."), (5, f"Haanth.\n\nnew words of the fifth alone\n{line}"), (6, f"{line}\n--"), (7, "\n"), (8, f"{line} and more\n\nown words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = {1: rows[0][1], 5: "\nnew words of the fifth alone", 7: "\n", 8: rows[7][1]}
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()} == want


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))) if w else None


def document_rows():
    rng = random.Random(9)
    vocabulary = [f"w{i}é" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 120))] for _ in range(12)]
    rows = []
    for d in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((d, " ".join(w)))
    return [*rows, (200, None), (201, ""), (202, "..."), (203, "a b"), (204, "A, b!"), (205, "word " * 20000)]


def brute_documents(rows):
    sets = {d: grams(t) for d, t in rows}
    distinct = list({s for s in sets.values() if s})
    top, links = groups(distinct, lambda a, b: 10 * len(a & b) >= 8 * len(a | b))
    copies = Counter(sets.values())
    least = {}
    for d, s in sets.items():
        if s:
            least[top(s)] = min(least.get(top(s), d), d)
    return sorted((d, least[top(s)], links[s], copies[s]) if s else (d, d, 0, 1) for d, s in sets.items())


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(bucket_join.shared_buckets, "__defaults__", (block, bucket_join.WEIGHT))
    rows = document_rows()
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id bigint, text string, n_links int").repartition(4)
    want = brute_documents(rows)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == want
    if block != 2:
        out = ngram_join.keep_one(docs)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted({r[1] for r in want})


def test_odd_documents(spark):
    schema = "doc_id bigint, text string"
    empty = spark.createDataFrame([], schema)
    assert ngram_join.near_duplicates(empty).isEmpty() and ngram_join.keep_one(empty).isEmpty()
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "other text")], schema)
    got = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 3, 0, 3), (3, 3, 0, 3), (4, 4, 0, 1), (None, 3, 0, 3)]
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == [3, 3, 4]


def test_shared_ids_lose_no_unique_text(spark):
    schema = "doc_id bigint, text string"
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "unique words of no other"), (7, "a b c d e f"), (7, "also like no other text")], schema)
    want = [("3", "a b c d e f"), ("7", "also like no other text"), ("None", "unique words of no other")]
    assert sorted((str(r.doc_id), r.text) for r in ngram_join.keep_one(docs).collect()) == want
    # Of one id and of null ids alike, one text of a class stays; repeated rows both do.
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty and"
    docs = spark.createDataFrame([(5, near), (5, near + " more"), (5, near + " other"), (None, "x y z"), (None, "X y z!"), (6, "a b"), (6, "a b")], schema)
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(docs).collect()) == ["5", "6", "6", "None"]
    line, other = "a line that is long enough to count", "words that stand in one document only"
    docs = spark.createDataFrame([(3, line), (7, line + "\nmore of seven"), (7, other), (None, "first of a null id\nx"), (None, "y\nx"), (None, other[:9])], schema)
    out = sorted((str(r.doc_id), r.text) for r in line_dedup.drop_repeated_lines(docs).collect())
    assert out[:3] == [("3", line), ("7", "more of seven"), ("7", other)]
    # The line that two documents with a null id share stays in one of them.
    assert sorted(x for d, t in out[3:] for x in t.split("\n")) == sorted(["first of a null id", "x", "y", other[:9]])


def test_band_choice():
    bands, rows = ngram_join.bands_and_rows(0.8, 0.999)
    assert bands * rows <= ngram_join.HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.999
    assert 1 - (1 - 0.8 ** (rows + 1)) ** (ngram_join.HASHES // (rows + 1)) < 0.999
    for threshold in (0.1, 0.3, 0.5, 0.69, 0.8, 0.95, 1.0):
        bands, rows = ngram_join.bands_and_rows(threshold, 0.99)
        assert bands * rows <= ngram_join.HASHES and 1 - (1 - threshold**rows) ** bands >= 0.99
    for wrong in ((0.7, 0.999, 4), (0, 0.9, 100), (1.1, 0.9, 100), (0.8, 1, 100)):
        with pytest.raises(ValueError):
            ngram_join.bands_and_rows(*wrong)
    assert words(b"A b-C\xc3\xa9 9") == [b"a", b"b", b"c\xc3\xa9", b"9"] and words(None) == []


def test_measured_recall_at_the_threshold():
    """Pairs of sets with a Jaccard similarity of 0.8 to 0.82 that share a band."""
    rng = np.random.default_rng(4)
    bands, rows = ngram_join.bands_and_rows()
    sign = ngram_join.Signer(bands, rows)
    met = 0
    for _ in range(400):
        both, own = int(rng.integers(200, 400)), 0
        own = round(both * (1 / rng.uniform(0.8, 0.82) - 1) / 2)
        x = rng.integers(0, 1 << 63, both + 2 * own, np.uint64)
        met += bool((sign(x[: both + own]) == sign(np.concatenate([x[:both], x[both + own :]]))).any())
    assert met >= 396


def test_buckets_of_equal_members_count_once(spark):
    m = spark.createDataFrame([(b, i, 1) for b in (7, 8) for i in (1, 2, 3)] + [(9, 1, 1), (9, 2, 1), (10, 5, 1)], "bucket bigint, id bigint, weight bigint")
    got = {r.id: [(b.bucket, b.blocks) for b in r.buckets] for r in bucket_join.shared_buckets(m, block=2).collect()}
    assert got == {1: [(7, 2), (9, 1)], 2: [(7, 2), (9, 1)], 3: [(7, 2)]}
