"""Benchmark decontamination with an FM-index over each training shard.

A task gathers documents into shards of bounded size. A shard's words become numbers
of the benchmark's vocabulary (0 for any other word), and an FM-index is built over
them: suffix order by prefix doubling, the Burrows-Wheeler transform in a wavelet
matrix, every ``SAMPLE``-th suffix position. All test phrases are searched backwards at
once through wavelet ranks; what is found is located by walking to a sampled position,
and the found windows are merged into removal spans.

Two exact reductions keep the index small: a word outside the benchmark's vocabulary
ends every match, so runs of such words are one 0; and a run of vocabulary words
shorter than the shortest phrase cannot hold one, so it is left out.

No row leaves its partition: the plan has no shuffle. The benchmark is read in blocks
of about ``block_bytes`` of text, one pass over the documents for each; where there are
several, the documents are written between the passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgraph.llm.common import _TO_WORDS, as_bytes, bound_batches, fresh, sliced, table, words, written

WINDOW = 13
SAMPLE = 8
SHARD_WORDS = 1 << 20
SHARD_BYTES = 24 << 20
BLOCK_BYTES = 16 << 20


class WaveletMatrix:
    """Ranks of symbols in an array of small integers."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels = []
        row = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (row >> b) & 1
            ones = np.zeros(len(row) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, len(row) - int(ones[-1]), ones))
            one = bit.astype(bool)
            row = np.concatenate([row[~one], row[one]])
        everything = np.arange(n_symbols)
        self.start = self._down(everything, np.zeros(n_symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, zeros, ones in self.levels:
            r = ones[at]
            at = np.where((symbol >> b) & 1, zeros + r, at - r)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, at) - self.start[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for _, zeros, ones in self.levels:
            r = ones[at]
            bit = ones[at + 1] - r
            symbol = symbol * 2 + bit
            at = np.where(bit, zeros + r, at - r)
        return symbol, at - self.start[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; each round sorts only suffixes still tied."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.empty(n, bool)
    head[:1] = True
    head[1:] = text[order][1:] != text[order][:-1]
    starts = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    sizes = np.bincount(rank, minlength=n)
    tied = np.flatnonzero(sizes[rank] > 1)
    k = 1
    while len(tied):
        after = np.where(tied + k < n, rank[np.minimum(tied + k, n - 1)], -1)
        order = np.lexsort((after, rank[tied]))
        tied, after = tied[order], after[order]
        group = rank[tied]
        new_group = np.append(True, group[1:] != group[:-1])
        new_tie = new_group | np.append(True, after[1:] != after[:-1])
        place = np.arange(len(tied))
        offset = place - np.maximum.accumulate(np.where(new_group, place, 0))
        rank[tied] = group + np.maximum.accumulate(np.where(new_tie, place, 0)) - place + offset
        sizes = np.diff(np.append(np.flatnonzero(new_tie), len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Backward search and located occurrences over an array of symbols 0..n_symbols-1."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        # Symbols move up by one; an end mark that is less than all of them and stands
        # once lets the text be read as a ring.
        text, n_symbols = np.append(text + 1, 0), n_symbols + 1
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=n_symbols)))
        self.wavelet = WaveletMatrix(bwt, n_symbols)
        sampled = sa % SAMPLE == 0
        self.sampled = np.append(0, np.cumsum(sampled))
        self.positions = sa[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of patterns, given as an array of rows of equal length."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for symbol in patterns.T[::-1]:
            s = symbol[alive] + 1
            lo[alive] = self.first[s] + self.wavelet.rank(s, lo[alive])
            hi[alive] = self.first[s] + self.wavelet.rank(s, hi[alive])
            gone = hi[alive] <= lo[alive]
            hi[alive[gone]] = lo[alive[gone]]
            alive = alive[~gone]
            if not len(alive):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps to the last position that was sampled."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            r = self.sampled[at]
            found = self.sampled[at + 1] > r
            out[left[found]] = self.positions[r[found]] + steps[found]
            left, at, steps = left[~found], at[~found], steps[~found]
            symbol, rank = self.wavelet.access_rank(at)
            at, steps = self.first[symbol] + rank, steps + 1
        return out


class Phrases:
    """The windows of a block of benchmark items, grouped by length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(numbers) - window + 1)) if numbers else ():
                owners.setdefault(tuple(numbers[i : i + window]), set()).add(item)
        self.vocabulary = vocabulary
        self.by_length = []
        for n in sorted({len(w) for w in owners}):
            rows = [w for w in owners if len(w) == n]
            self.by_length.append((n, np.array(rows, np.int64), [sorted(owners[w]) for w in rows]))
        self.shortest = self.by_length[0][0] if self.by_length else 0


def _runs(numbers: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], numbers != 0, [0]])))
    starts, ends = edge[::2], edge[1::2]
    for k in np.flatnonzero(ends - starts >= least):
        yield int(starts[k]), int(ends[k])


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Unions of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


class Shard:
    """Documents of a task until they are searched together."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.docs, self.parts, self.origins = phrases, [], [np.zeros(1, np.int64)], []
        self.size, self.raw = 1, 0

    def add(self, text: bytes | None) -> None:
        tokens = words(text)
        doc = len(self.docs)
        self.docs.append(len(tokens))
        self.raw += len(text or b"")
        if not self.phrases.shortest:
            return
        numbers = np.fromiter(map(self.phrases.vocabulary.get, tokens, repeat(0)), np.int64, len(tokens))
        for s, e in _runs(numbers, self.phrases.shortest):
            self.parts += [numbers[s:e], np.zeros(1, np.int64)]
            self.origins.append((self.size, doc, s))
            self.size += e - s + 1

    def results(self) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each document: number of words, merged spans of words, items found."""
        found: dict[int, tuple[list, list, set]] = {}
        if self.origins:
            index = FMIndex(np.concatenate(self.parts), len(self.phrases.vocabulary) + 1)
            begin, doc, word = np.array(self.origins, np.int64).T
            for n, patterns, owners in self.phrases.by_length:
                lo, hi = index.search(patterns)
                some = np.flatnonzero(hi > lo)
                if not len(some):
                    continue
                counts = hi[some] - lo[some]
                rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[some], counts)
                positions, which = index.locate(rows), np.repeat(some, counts)
                run = np.searchsorted(begin, positions, side="right") - 1
                for d, at, w in zip(doc[run].tolist(), (word[run] + positions - begin[run]).tolist(), which.tolist(), strict=True):
                    starts, ends, items = found.setdefault(d, ([], [], set()))
                    starts.append(at)
                    ends.append(at + n)
                    items.update(owners[w])
        out = []
        for d, n_words in enumerate(self.docs):
            starts, ends, items = found.get(d, ([], [], set()))
            out.append((n_words, merge_spans(np.array(starts, np.int64), np.array(ends, np.int64)), sorted(items)))
        return out


_SPAN = "array<struct<start:bigint,end:bigint>>"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list[tuple[str, bytes | None]], bool]]:
    """The benchmark in blocks of about ``block_bytes``, one at a time, each with whether
    it is the last; a block is all that the driver or a task ever holds of it."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("binary").alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = size // block_bytes + 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        yield [(r.i, bytes(r.t) if r.t is not None else None) for r in rows.filter(part == k).toLocalIterator()], k == n - 1


def find_spans(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with the columns ``n_words``, ``spans`` (merged half-open word spans) and
    ``items`` (ids of items found, as sorted strings). Columns of those names that
    ``docs`` already has are replaced.

    Null and empty texts, and texts without words, have no words and no spans. A null
    item id reads as an empty id; items without words are never found; items of one id
    count once. Repeated rows each get their own result.
    """
    return _searched(docs, benchmark, text_col, item_col, item_text_col, window, block_bytes)


def _searched(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, block_bytes: int, finish: Callable | None = None, schema=None) -> DataFrame:
    """``find_spans``; with ``finish``, each batch of the result is handed to it where it is
    made, and becomes a batch of ``schema``."""
    spark = docs.sparkSession
    bound_batches(spark)
    rest = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    out = docs.select(*rest, F.lit(0).cast("bigint").alias("n_words"), F.expr(f"cast(array() as {_SPAN})").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for block, last in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(Phrases(block, window))
        del block

        end = finish if last else None

        def search(batches: Iterator[pa.RecordBatch], shared=shared, end=end) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 2000):
                texts = as_bytes(batch.column(batch.schema.get_field_index(text_col)))
                results, shard = [], Shard(shared.value)
                for text in texts:
                    shard.add(text)
                    if shard.size >= SHARD_WORDS or shard.raw >= SHARD_BYTES:
                        results += shard.results()
                        shard = Shard(shared.value)
                results += shard.results()
                old = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("spans", "items")]
                spans, items = [], []
                for (_, new, its), before, had in zip(results, *old, strict=True):
                    if before:
                        new = merge_spans(np.array([s for s, _ in new] + [x["start"] for x in before]), np.array([e for _, e in new] + [x["end"] for x in before]))
                    spans.append([{"start": s, "end": e} for s, e in new])
                    items.append(sorted({*its, *had}))
                span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                made = [pa.array([n for n, _, _ in results], pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))]
                whole = pa.RecordBatch.from_arrays([*batch.columns[:-3], *made], names=batch.schema.names)
                yield end(whole) if end else whole

        out = out.mapInArrow(search, schema if end else out.schema)
        if not last:
            # Written, so that no two blocks are in memory together.
            out = written(out, "spans")
            shared.destroy()
    return out


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    text_col = options.get("text_col", "text")
    found = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(text_col)), benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    marked = text.translate(_TO_WORDS)
    at, places, out, i = 0, [], bytearray(), 0
    for w in marked.split():
        i = marked.index(w, i)
        places.append((i, i + len(w)))
        i += len(w)
    for s, e in spans:
        out += text[at : places[s][0]]
        at = places[e - 1][1]
    return bytes(out + text[at:])


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated documents; from the others the found spans are cut.
    Columns and their order stay; null texts stay null."""
    # Columns of the names that are found here step aside meanwhile.
    own = docs.withColumnsRenamed({c: fresh(docs, f"own_{c}") for c in ("n_words", "spans", "items") if c in docs.columns})
    schema = own.schema
    names = [f.name for f in schema.fields]

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
        n_words = batch.column(batch.schema.get_field_index("n_words")).to_pylist()
        hit = [sum(x["end"] - x["start"] for x in s) for s in spans]
        keep = [not (h and 20 * h >= n) for h, n in zip(hit, n_words, strict=True)]
        columns = list(batch.columns)
        if any(hit):
            texts = as_bytes(batch.column(at))
            texts = [cut_spans(t, [(x["start"], x["end"]) for x in s]) if s and k else t for t, s, k in zip(texts, spans, keep, strict=True)]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
        own = [columns[batch.schema.get_field_index(c)] for c in names]
        return pa.RecordBatch.from_arrays(own, names=names).filter(pa.array(keep, pa.bool_()))

    # Cut where the spans are found: one worker for each task, not two.
    return _searched(own, benchmark, text_col, item_col, item_text_col, window, block_bytes, remove, schema).toDF(*docs.columns)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
o AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT o.r, o.i, o.n, p.item FROM o JOIN p ON o.n = p.n AND o.phrase = p.phrase),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r
"""
