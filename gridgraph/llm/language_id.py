"""Language identification with error-correcting output codes.

Every language has a codeword of bits, and for each bit a binary classifier over hashed
byte n-grams says on which side a text stands. Decoding weighs each bit's logistic loss
by how well that bit's classifier knows the language, and takes the language of least
loss; a text whose best two languages are close is marked as ambiguous.

Up to six languages have the exhaustive code (every split of the languages is a bit),
more of them have the best of some seeded random codes. Classifiers are fitted on a
bounded sample of labelled rows, prediction reads whole texts of all rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgraph.llm.common import as_bytes, bound_batches, fresh, sliced, table

#: Rows that the classifiers are fitted on, at most; languages have equal shares.
SAMPLE_ROWS = 2400
#: Hashed n-grams of three bytes fall into 2 ** BITS features.
BITS = 12
#: A text whose best language has a lower share of the likelihood is ambiguous.
CERTAIN = 0.6
UNKNOWN = "und"
_CHUNK = 1 << 20
_SPREAD = 1 << 40

#: ASCII that is no letter becomes a blank.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of n languages."""
    if n < 2:
        return np.ones((n, 0), np.float32)
    if n <= 6:
        # The first language is always +1; the others take every pattern but all +1.
        patterns = np.arange((1 << (n - 1)) - 1)
        return np.array([np.ones(len(patterns))] + [np.where(patterns >> k & 1, 1, -1) for k in range(n - 1)], np.float32)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, 15 * math.ceil(math.log2(n))))
        apart = int(((code.shape[1] - code @ code.T) / 2 + code.shape[1] * np.eye(n)).min())
        split = (np.abs(code.sum(axis=0)) < n).all()
        if split and apart > far:
            best, far = code, apart
    return best


def features(text: bytes | None) -> np.ndarray | None:
    """Square roots of the text's hashed n-gram counts, of length 1; None if no letter."""
    if not text:
        return None
    plain = text.decode("utf-8", "replace")
    if not any(map(str.isalpha, plain)):
        return None
    low = (" " + plain.lower() + " ").encode().translate(_LETTERS)
    counts = np.zeros(1 << BITS)
    for at in range(0, len(low), _CHUNK):
        a = np.frombuffer(low, np.uint8, min(_CHUNK + 2, len(low) - at), at).astype(np.uint32)
        if len(a) < 3:
            continue
        h = a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D)
        # Blanks around blanks say nothing.
        h = h[(a[1:-1] != 32)] >> np.uint32(32 - BITS)
        counts += np.bincount(h, minlength=1 << BITS)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else np.zeros(1 << BITS, np.float32)


class Model:
    """Languages, codewords, and one linear classifier for each bit."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, steps: int = 120, decay: float = 1e-4):
        self.languages = languages
        self.code = codewords(len(languages))
        n, bits = len(x), self.code.shape[1]
        self.weights, self.bias = np.zeros((x.shape[1] if n else 1 << BITS, bits), np.float32), np.zeros(bits, np.float32)
        if not bits:
            return
        target = self.code[y]
        share = np.bincount(y, minlength=len(languages)).astype(np.float32)
        row = (1 / (len(languages) * share[y]))[:, None]  # languages weigh the same
        w, b, last_w = self.weights, self.bias, self.weights
        for t in range(steps):  # Nesterov's method; rows have length 1
            ahead = w + (t / (t + 3)) * (w - last_w)
            grad = -target / (1 + np.exp(np.clip(target * (x @ ahead + b), -30, 30))) * row
            last_w, w = w, ahead - 6.0 * (x.T @ grad + decay * ahead)
            b = b - 1.0 * grad.sum(axis=0)
        self.weights, self.bias = w.astype(np.float32), b.astype(np.float32)
        right = (np.sign(x @ self.weights + self.bias) == target).astype(np.float32)
        known = np.array([right[y == k].mean(axis=0) for k in range(len(languages))]) + 1e-6
        self.trust = known / known.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword, and its share of the likelihood, by row."""
        if len(self.languages) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = (x @ self.weights + self.bias)[:, None, :] * self.code
        loss = (np.logaddexp(0, -margin) * self.trust).sum(axis=2)
        like = np.exp(-self.code.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
        best = loss.argmin(axis=1)
        return best, 1 / like.sum(axis=1)


def _chosen(rows: DataFrame, counts: dict[str, int], each: int) -> list[tuple[str, int]]:
    """For each language, its ``each`` distinct texts of least hash, as (language, hash):
    the same whatever the order and the number of copies of rows."""
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(_SPREAD, 1 + _SPREAD * 4 * each // n))])
    some = rows.filter(F.pmod("h", F.lit(_SPREAD)) < share[F.col("l")]).select("l", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.pmod("h", F.lit(_SPREAD)), "h"))
    return [(r.l, r.h) for r in some.withColumn("r", rank).filter(F.col("r") <= each).collect()]


def fit(labelled: DataFrame, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``sample_rows`` different texts with a language and a letter: those
    of least hash, as many of each language, so that the sample is the same whatever the
    order of rows. Their features are made where the rows are. Of more languages than
    ``sample_rows``, the most frequent are learned."""
    bound_batches(labelled.sparkSession)
    text = F.col(text_col).cast("string")
    rows = labelled.filter(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("l"), text.alias("t"), F.xxhash64(text).alias("h"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(sample_rows).collect()}
    if not counts:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0, np.int64))
    each = max(1, sample_rows // len(counts))
    keys = _chosen(rows, counts, each)
    found = Counter(k[0] for k in keys)
    # Where copies took the place of other texts, all texts are looked at.
    few = {k: 1 for k, n in counts.items() if found[k] < each and 4 * each < n}
    if few:
        keys = [k for k in keys if k[0] not in few] + _chosen(rows, few, each)
    wanted = labelled.sparkSession.createDataFrame(keys, "l string, h bigint")
    # At most sample_rows keys, so they may go to every task.
    texts = rows.join(F.broadcast(wanted), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2000):
            made = [(lang, x) for lang, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True) if (x := features(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1].tobytes() for m in made], pa.binary())], names=["l", "x"])

    kept = sorted((r.l, bytes(r.x)) for r in texts.select("l", "t").mapInArrow(run, "l string, x binary").toLocalIterator())
    languages = sorted({k[0] for k in kept})
    x = np.frombuffer(b"".join(k[1] for k in kept), np.float32).reshape(len(kept), 1 << BITS)
    return Model(languages, x, np.array([languages.index(k[0]) for k in kept], np.int64))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", ambiguous_out: str = "ambiguous", certain: float = CERTAIN) -> DataFrame:
    """``docs`` with the predicted language, a score from 0 to 1, and whether the
    prediction is ambiguous, in place of columns of those names.

    A null text, one without a letter, and any text where no language was learned is
    ``und`` with score 0, and not ambiguous. Equal losses go to the first language in
    alphabetical order. Repeated rows each get their own result.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.select(*[c for c in docs.columns if c not in (lang_out, score_out, ambiguous_out)])
    text = fresh(rest, "text_read")
    names = [*rest.columns, lang_out, score_out, ambiguous_out]
    full = rest.select("*", F.lit("").alias(lang_out), F.lit(0.0).alias(score_out), F.lit(False).alias(ambiguous_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches, 2000):
            langs, scores = [], []
            texts = as_bytes(batch.column(batch.num_columns - 1))
            for at in range(0, len(texts), 64):
                xs = [features(t) if model.languages else None for t in texts[at : at + 64]]
                some = [x for x in xs if x is not None]
                told = iter(zip(*(a.tolist() for a in model.predict(np.array(some))), strict=True)) if some else iter(())
                for x in xs:
                    best, score = next(told) if x is not None else (None, 0.0)
                    langs.append(UNKNOWN if best is None else model.languages[best])
                    scores.append(score)
            unsure = [lang != UNKNOWN and s < certain for lang, s in zip(langs, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], names=names)

    return rest.select("*", F.col(text_col).cast("string").alias(text)).mapInArrow(run, full.schema)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; -1 for a null id, which is neither learned from
    nor held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(-1))


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(fold() > 0), "text", "lang")
    rows = docs.select("doc_id", (fold() == 0).alias("held_out"), "text")
    return predict(rows, model).drop("text")


def keep_known(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those that the classifier rejects: no letter, or ambiguous."""
    model = fit(docs.filter(fold(id_col) > 0), text_col, lang_col)
    lang, score, unsure = (fresh(docs, c) for c in ("lang_told", "lang_score", "lang_unsure"))
    told = predict(docs, model, text_col, lang, score, unsure)
    return told.filter((F.col(lang) != UNKNOWN) & ~F.col(unsure)).select(*docs.columns)
