"""Near-duplicate documents: a Jaccard join on word n-grams by MinHash banding.

A text's set of hashed word n-grams gives one signature; rows and bands are chosen so
that a pair at the threshold shares a band with the target probability. Texts with equal
sets are one before anything else. The shuffle is on band hashes and ids alone; texts
are fetched for those that met another, and pairs are verified on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgraph.llm.bucket_join import classes, link, shared_buckets
from gridgraph.llm.common import as_bytes, bound_batches, fresh, sliced, table, words, written

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Hash functions of a signature, at most.
HASHES = 100
#: Words whose hashes a worker keeps.
KNOWN = 1 << 18
_STEP = 4096


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """The longest bands (fewest chance meetings) of which enough fit into ``hashes`` to
    meet the recall at the threshold. An error, if not even bands of one row do."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("a threshold is above 0 and at most 1, a recall between 0 and 1")
    best = None
    for rows in range(1, hashes + 1):
        bands = math.log1p(-recall) / math.log1p(-(threshold**rows)) if threshold**rows < 1 else 1
        if bands * rows > hashes + 1:
            break  # longer bands need more
        if math.ceil(bands) * rows <= hashes:
            best = (math.ceil(bands), rows)
    if best is None:
        raise ValueError(f"a recall of {recall} at {threshold} needs more than {hashes} hash functions")
    return best


class WordHashes(dict):
    """64-bit hashes of words, kept for the next time in a table of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes | None, hashes: WordHashes, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams of words. A text of fewer words, but
    not none, is one n-gram."""
    own = words(text)
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
    size = min(n, len(own))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(1 << 31, 1 << 32, bands * rows, np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)[:, None]

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each band of the set's signature."""
        short = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), _STEP):
            np.minimum(least, (short[at : at + _STEP] * self.factor + self.add).min(axis=1), out=least)
        out = np.arange(self.bands, dtype=np.uint64)
        for column in least.reshape(self.bands, self.rows).T:
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return out


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """Two hashes that together stand for a set."""
    raw = grams.tobytes()
    return xxhash.xxh3_64_intdigest(raw), xxhash.xxh3_64_intdigest(raw, 1)


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, t1 (a hash of the text), k1, k2 (null without words), size (n-grams), bands
    (array of band hashes)."""
    schema = "doc_id bigint, t1 bigint, k1 bigint, k2 bigint, size bigint, bands array<bigint>"
    signer = Signer(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches, 2000):
            keys, signs, sizes = [], [], []
            for text in as_bytes(batch.column(2)):
                grams = shingles(text, hashes, n)
                sizes.append(len(grams))
                keys.append(_signed(set_key(grams)) if len(grams) else (None, None))
                signs.append(signer(grams).view(np.int64) if len(grams) else np.zeros(0, np.int64))
            offsets = np.append(0, np.cumsum([len(s) for s in signs])).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(signs) if signs else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sizes, pa.int64()), made], names=["doc_id", "t1", "k1", "k2", "size", "bands"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("t1"), text.alias("t")).mapInArrow(run, schema)


def _signed(pair: tuple[int, int]) -> tuple[int, int]:
    return tuple(x - (1 << 64) if x >> 63 else x for x in pair)


class _Verifier:
    """Similar sets of a unit. A set's hashes mark slots; the marked slots of the others
    bound their overlaps from above, and what passes the bound is counted exactly."""

    SLOTS = 22

    def __init__(self, n: int, threshold: float):
        self.n, self.threshold = n, threshold

    def prepare(self, texts: list[bytes]) -> tuple:
        hashes = WordHashes()
        sets = [shingles(t, hashes, self.n) for t in texts]
        slots = [(s >> np.uint64(64 - self.SLOTS)).astype(np.int32) for s in sets]
        return sets, slots, np.array([len(s) for s in sets]), np.zeros(1 << self.SLOTS, bool)

    def linked(self, ready: tuple, i: int, js: np.ndarray) -> list[int]:
        sets, slots, sizes, mark = ready
        # Sets of too different sizes can't reach the threshold.
        small, large = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
        js = js[small >= self.threshold * large - 1e-9]
        if not len(js):
            return []
        mark[slots[i]] = True
        out = []
        for j in js.tolist():
            need = self.threshold / (1 + self.threshold) * (sizes[i] + sizes[j]) - 1e-6
            if np.count_nonzero(mark[slots[j]]) >= need:
                both = int(sizes[i] + sizes[j] - len(np.union1d(sets[i], sets[j])))
                if both >= self.threshold * (sizes[i] + sizes[j] - both) - 1e-9:
                    out.append(j)
        mark[slots[i]] = False
        return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of those joined to it by
    chains of similar documents), n_links (other documents' different n-gram sets that
    are similar to this one's) and n_copies (documents with the very same set, itself
    included).

    Null texts and texts without words are like no other: class_id is their own id,
    n_links 0, n_copies 1. A document with a null id takes part and has the least id of
    the others as class_id (null, if all are null). Repeated rows each get a row.
    """
    return _told(docs, id_col, text_col, n, threshold, recall, hashes).drop("t1", "keep")


def _told(docs: DataFrame, id_col: str, text_col: str, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """The rows of ``near_duplicates`` with t1, the hash of the text, and keep: whether id and
    text are those that stand for the class."""
    bound_batches(docs.sparkSession)
    bands, rows = bands_and_rows(threshold, recall, hashes)
    signed = written(signatures(docs, id_col, text_col, n, bands, rows), "signatures")
    sets = signed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1")).alias("least"), F.count(F.lit(1)).alias("n_copies"), F.max("size").alias("weight"), F.min("bands").alias("bands"))
    sets = written(sets, "sets")
    met = shared_buckets(sets.select(F.explode("bands").alias("bucket"), F.col("k1").alias("id"), "weight").groupBy("bucket", "id").agg(F.max("weight").alias("weight")))
    asked = sets.join(met.withColumnRenamed("id", "k1"), "k1").select("least.doc_id", "least.t1", "k1", "k2", "buckets")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("bigint").alias("own"), F.xxhash64(text).alias("hashed"), text.alias("t"))
    key = F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0"))
    # Rows that repeat an id and text give the text again; it counts once.
    found = asked.join(texts, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("t1") == F.col("hashed"))).select(key.alias("key"), "buckets", "t")
    check = _Verifier(n, threshold)
    near = classes(link(found, "key", "buckets", "t", check.prepare, check.linked))
    near = written(sets.select(key.alias("key"), "k1", "k2", "least").join(near, "key").select("k1", "k2", "least", "n_links", "root"), "set-links")
    near = near.join(near.groupBy("root").agg(F.min("least").alias("class")), "root").select("k1", "k2", "class", "n_links")
    told = sets.select("k1", "k2", "least", "n_copies").join(near, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("class", "least").alias("class"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_copies")
    # Written, so that the join below has an exchange on either side: then a key that a
    # third of all documents share can be split.
    told = written(told, "set-classes")
    alone = signed.filter("k1 is null").select("doc_id", "t1", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(True).alias("keep"))
    keep = F.col("doc_id").eqNullSafe(F.col("class.doc_id")) & (F.col("t1") == F.col("class.t1"))
    return signed.filter("k1 is not null").select("doc_id", "t1", "k1", "k2").join(told, ["k1", "k2"]).select("doc_id", "t1", F.col("class.doc_id").alias("class_id"), "n_links", "n_copies", keep.alias("keep")).unionAll(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: that of the least id, and of several with
    this id that of the least hash of its text; rows that repeat this id and text stay.
    Null ids come last: one stays only in classes where every id is null. Texts that are
    null or have no words stay."""
    own, hashed = fresh(docs, "gone_id"), fresh(docs, "gone_hash")
    told = _told(docs, id_col, text_col, **options)
    # An id alone does not tell rows with null or repeated ids from one another.
    gone = told.filter(~F.col("keep")).select(F.col("doc_id").alias(own), F.col("t1").alias(hashed)).distinct()
    return docs.join(gone, docs[id_col].cast("bigint").eqNullSafe(gone[own]) & (F.xxhash64(docs[text_col].cast("string")) == gone[hashed]), "left_anti")


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
