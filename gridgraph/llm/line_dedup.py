"""Near-duplicate lines by a segment-partition edit join.

Two lines within THRESHOLD edits: if one is cut into THRESHOLD + 1 segments, at least one
segment stands unchanged in the other, close to its place. So each line is indexed under
its segments, by length, number and content, and probes the segments of lines of its own
length and up to THRESHOLD shorter with those of its substrings that can be the
unchanged one (starts within what edits on the left and on the right allow). Lines that
meet under a key are verified with a banded bit-parallel edit distance.

Many lines may share a segment and nothing else (a common beginning). What is left of
them beside it is segmented again, with the edits that may be there, so that only lines
meet that are alike there too.

Equal lines are one before the join: a task passes on each line once, and keys see
distinct lines only. Keys and hashes travel, texts are fetched for lines that met others.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgraph.llm.bucket_join import classes, link, shared_buckets
from gridgraph.llm.common import as_bytes, bound_batches, fresh, sliced, table, written

#: Edits within which lines count as one.
THRESHOLD = 2
#: Shorter lines (in code points) are held to be one only where they are equal: two edits
#: would make other words of them.
LEAST = 24
#: Share of a document that has to stand in another one to make it a copy.
COPY = 0.8
#: A byte of a word, as ``common.words`` has them.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Lines that a task remembers in order not to pass them on again.
SEEN = 1 << 18
#: Lines of a block that are compared with one another.
BLOCK = 256
#: Larger buckets of unlike lines are taken apart by further segments, so many times at most.
HOT, LEVELS = 2048, 6


def segments(n: int, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Start and length of the threshold + 1 even segments of a line of n characters."""
    parts = threshold + 1
    short, longer = divmod(n, parts)
    out, at = [], 0
    for k in range(parts):
        size = short + (k >= parts - longer)
        out.append((at, size))
        at += size
    return out


def probes(n: int, threshold: int = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(length, segment, start, size): the substrings with which a line of n characters
    looks for lines of its length or less; its own segments are the first."""
    own = [(n, k, at, size) for k, (at, size) in enumerate(segments(n, threshold))]
    out = list(own)
    for gap in range(threshold + 1):
        for k, (at, size) in enumerate(segments(n - gap, threshold)):
            left, right = k, threshold - k
            for start in range(max(at - left, at + gap - right, 0), min(at + left, at + gap + right, n - size) + 1):
                if (n - gap, k, start, size) not in own:
                    out.append((n - gap, k, start, size))
    return out


def _shared(a: str, b: str, most: int) -> int:
    """Length of the common start of two texts, by halving."""
    low = 0
    while low < most:
        half = (low + most + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            most = half - 1
    return low


def within(a: str, b: str, threshold: int = THRESHOLD) -> bool:
    """Whether a and b are within ``threshold`` edits: banded bit-parallel columns.

    Bit r of the masks is row ``j - threshold + r`` of column j, so the band moves down
    a row with each column; the distance is followed along the band's lower edge, then
    along the last row.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > threshold:
        return False
    k = _shared(a, b, len(b))
    a, b = a[k:], b[k:]
    e = _shared(a[::-1], b[::-1], len(b))
    a, b = a[: len(a) - e], b[: len(b) - e]
    if not b:
        return True  # the rest of a is the difference of lengths
    m, width = len(a), 2 * threshold + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    vp, vn, distance = full & ~((1 << threshold) - 1), 0, threshold
    # Beyond the last row, the edge follows the row itself, one bit lower each time.
    edge = top
    for j, c in enumerate(b):
        low = j - threshold
        eq = 0
        for r in range(max(0, -low), min(width, m - low)):
            if a[low + r] == c:
                eq |= 1 << r
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j + threshold < m:
            distance += not d0 & top
            if distance > 2 * threshold:
                return False
        else:
            edge >>= 1
            distance += bool(hp & edge) - bool(hn & edge)
        vp, vn = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
    return distance <= threshold


def _text(column: str):
    return F.col(column).cast("string")


def line_keys(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """doc_id, t1 (a hash of the text), line_no (from 0), k1, k2, size: the lines that take
    part, with two hashes that together stand for their content, and size."""
    lines = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(_text(text_col)).alias("t1"), F.posexplode(F.split(_text(text_col), "\n", -1)).alias("line_no", "line"))
    return lines.filter(F.length("line") >= least).select("doc_id", "t1", "line_no", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(3), "line").alias("k2"), F.length("line").cast("bigint").alias("size"))


def _candidates(docs: DataFrame, text_col: str, least: int, threshold: int) -> DataFrame:
    """members(bucket, id): lines (by k1) that share a key with another line, where at
    least one is indexed under it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        plans: dict[int, list] = {}
        digest = xxhash.xxh3_64_intdigest
        for batch in sliced(batches, 2000):
            keys, ids = [], []
            for text in as_bytes(batch.column(0)):
                for raw in text.split(b"\n") if text else ():
                    if len(raw) < least:
                        continue
                    own = xxhash.xxh64_intdigest(raw, 42)
                    if own in seen:
                        continue
                    line = raw.decode("utf-8", "replace")
                    n = len(line)
                    if n < least:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(own)
                    plan = plans.get(n)
                    if plan is None:
                        if len(plans) > 20_000:
                            plans.clear()
                        plan = plans[n] = [(at, at + size, (length * 16 + k) & 0xFFFFFFFF, int(i > threshold)) for i, (length, k, at, size) in enumerate(probes(n, threshold))]
                    whole = n == len(raw)
                    for at, end, seed, role in plan:
                        # The last bit says whether the line only probes; indexed lines sort first.
                        keys.append((digest(raw[at:end] if whole else line[at:end].encode(), seed) & ~1) | role)
                        ids.append(own)
                if len(keys) > 200_000:
                    yield _keys(keys, ids)
                    keys, ids = [], []
            yield _keys(keys, ids)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # group, indexed, id of its first member, whether that was given out
        for batch in batches:
            key, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(key):
                continue
            group = key & ~np.int64(1)
            head = np.append(True, group[1:] != group[:-1])
            first = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
            indexed = (key[first] & 1) == 0
            fresh_row = np.append(True, (group[1:] != group[:-1]) | (own[1:] != own[:-1]))
            n = np.diff(np.append(np.flatnonzero(head), len(key)))
            out_group, out_id = [], []
            carried = last is not None and last[0] == group[0]
            if carried:
                part = n[0]
                indexed[:part] = last[1]
                others = own[:part] != last[2]
                if last[1] and others.any() and not last[3]:
                    out_group.append(np.array([group[0]]))
                    out_id.append(np.array([last[2]]))
                    last = (last[0], True, last[2], True)
            sizes = np.repeat(n, n)
            # A run of one line alone, met twice or probing itself, is no candidate.
            differs = np.repeat(np.maximum.reduceat(own, np.flatnonzero(head)) != np.minimum.reduceat(own, np.flatnonzero(head)), n)
            if carried:
                differs[:part] = (own[:part] != last[2]).any() or last[3]
                sizes[:part] = 2
            take = indexed & differs & (sizes > 1) & fresh_row
            out_group.append(group[take])
            out_id.append(own[take])
            at = first[-1]
            if carried and at == 0:
                last = (last[0], last[1], last[2], last[3])
            else:
                last = (group[-1], bool(indexed[-1]), own[at], bool(differs[-1] & indexed[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_group)), pa.array(np.concatenate(out_id))], names=["bucket", "id"])

    emitted = docs.select(_text(text_col).alias("t")).mapInArrow(emit, "key bigint, id bigint")
    met = emitted.repartition(F.shiftright("key", 1)).sortWithinPartitions("key", "id").mapInArrow(meet, "bucket bigint, id bigint")
    return met.distinct()


def _keys(keys: list[int], ids: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, ids)], names=["key", "id"])


def bigram_parity(lines: list[str]) -> np.ndarray:
    """64 bits for each line: whether the number of its pairs of neighbouring characters
    in each of 64 classes is odd. An edit changes four pairs at most, so lines within n
    edits differ in 4 n bits at most."""
    codes = np.frombuffer("".join([x + "\n" for x in lines]).encode("utf-32-le", "surrogatepass"), np.uint32)
    following = np.append(codes[1:], np.uint32(10))
    h = (codes * np.uint32(0x9E3779B1) ^ following * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> np.uint32(26)
    ends = np.cumsum([len(x) + 1 for x in lines])
    bits = np.uint64(1) << h.astype(np.uint64)
    bits[ends - 1] = 0  # the pair of two lines
    return np.bitwise_xor.reduceat(bits, np.append(0, ends[:-1]))


Gap = tuple[int, int, int, int]  # length in the indexed line, start and end in this one, edits left


def first_states(line: str, wanted: set[int], threshold: int) -> Iterator[tuple[int, int, list[Gap]]]:
    """(bucket, role, gaps) for each of a line's keys that is one of the buckets: what is
    left of it beside the substring, and how many edits may be there."""
    n = len(line)
    for i, (length, k, at, size) in enumerate(probes(n, threshold)):
        bucket = _key(line[at : at + size].encode(), (length * 16 + k) & 0xFFFFFFFF)
        if bucket in wanted:
            own = segments(length, threshold)[k][0]
            yield bucket, int(i > threshold), [g for g in ((own, 0, at, k), (length - own - size, at + size, n, threshold - k)) if g[3]]


def _key(content: bytes, seed: int) -> int:
    """A key as ``_candidates`` has it, without the bit of its role."""
    value = xxhash.xxh3_64_intdigest(content, seed) & ~1
    return value - (1 << 64) if value >> 63 else value


def finer(line: str, bucket: int, role: int, gaps: list[Gap]) -> Iterator[tuple[int, int, list[Gap]]]:
    """The buckets into which a line of a bucket falls when the longest gap is segmented in
    its turn: lines that are similar in the gaps share one of them. Gaps without edits
    have to be equal, so they go into the key."""
    place = max((k for k, g in enumerate(gaps) if g[0] > g[3]), key=lambda k: gaps[k][0], default=None)
    if place is None:
        yield _key(f"{bucket} {gaps and [g[0] for g in gaps]}".encode(), 1), role, gaps
        return
    length, a, b, edits = gaps[place]
    n = b - a
    gap = n - length
    for k, (at, size) in enumerate(segments(length, edits)):
        left, right = k, edits - k
        for s in range(max(at - left, at + gap - right, 0), min(at + left, at + gap + right, n - size) + 1):
            before, inside, behind = line[a : a + s], line[a + s : a + s + size], line[a + s + size : b]
            fixed = f"{bucket} {place} {k} {len(inside)} {inside}{'' if left else before}\n{'' if right else behind}"
            now = [(at, a, a + s, left), (length - at - size, a + s + size, b, right)]
            yield _key(fixed.encode(), 2), int(role or s != at or gap != 0), [*gaps[:place], *[g for g in now if g[3]], *gaps[place + 1 :]]


def _refined(members: DataFrame, fetch: Callable[[DataFrame], DataFrame], threshold: int) -> DataFrame:
    """``members`` with large buckets of lines that are mostly unlike taken apart, until
    they are small, alike, or cut ``LEVELS`` times. Similar lines still share a bucket."""
    hot = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("bucket")
    hot = written(hot, "line-hot")
    if hot.isEmpty():
        return members
    inside = members.join(hot, "bucket")
    lines = written(fetch(inside.select(F.col("id").alias("k1")).distinct()).select(F.col("k1").alias("id"), "line"), "line-hot-texts")
    done = [members.join(hot, "bucket", "left_anti")]
    now = inside.select("bucket", "id", F.lit(None).cast("string").alias("state"))
    schema = "bucket bigint, id bigint, state string, parity bigint, role int"

    for level in range(LEVELS + 1):

        def run(batches: Iterator[pa.RecordBatch], split: bool = level > 0) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 2000):
                out: list[tuple] = []
                for own, raw, asked in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    line = raw.decode("utf-8", "replace")
                    parity = int(bigram_parity([line])[0].astype(np.int64))
                    if split:
                        found = {x for r in asked for x in map(_state, finer(line, r["bucket"], *json.loads(r["state"])))}
                    else:
                        found = set(map(_state, first_states(line, {r["bucket"] for r in asked}, threshold)))
                    out += [(bucket, own, state, parity, role) for bucket, role, state in found]
                    if len(out) > 50_000:
                        yield _rows(out, schema)
                        out = []
                yield _rows(out, schema)

        asked = now.groupBy("id").agg(F.collect_list(F.struct("bucket", "state")).alias("asked"))
        made = written(lines.join(asked, "id").select("id", "line", "asked").mapInArrow(run, schema), "line-finer")
        # Sixteen members by hash tell whether a bucket's lines are alike; that decides how
        # it is worked on, never what comes out.
        some = F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64(F.lit(r), "id"), "id", "parity")) for r in range(16)]))
        told = made.groupBy("bucket").agg(F.approx_count_distinct("id").alias("about"), F.count(F.lit(1)).alias("n"), F.min("role").alias("role"), some.alias("some"))
        pairs = F.flatten(F.transform("some", lambda x: F.transform("some", lambda y: F.when(x["id"] != y["id"], F.bit_count(x["parity"].bitwiseXOR(y["parity"])) <= 4 * threshold))))
        alike = F.size(F.filter(pairs, lambda p: p)) * 2 >= F.size(F.filter(pairs, lambda p: p.isNotNull()))
        told = told.filter("role = 0 and n > 1").select("bucket", ((F.col("n") > HOT) & (F.col("about") > HOT // 2) & ~alike).alias("again"))
        told = written(told, "line-finer-sizes")
        again = told.filter("again") if level < LEVELS else told.limit(0)
        done.append(made.select("bucket", "id").distinct().join(told.select("bucket").join(again.select("bucket"), "bucket", "left_anti"), "bucket"))
        if again.isEmpty():
            break
        now = made.join(again.select("bucket"), "bucket").select("bucket", "id", "state")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return written(out, "line-members-finer")


def _state(found: tuple[int, int, list[Gap]]) -> tuple[int, int, str]:
    bucket, role, gaps = found
    return bucket, role, json.dumps([role, gaps])


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    names = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _verifier(threshold: int):
    def prepare(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        lines = [t.decode("utf-8", "replace") for t in texts]
        return lines, np.array([len(x) for x in lines]), bigram_parity(lines)

    def linked(ready: tuple, i: int, js: np.ndarray) -> list[int]:
        lines, sizes, parity = ready
        near = (np.abs(sizes[js] - sizes[i]) <= threshold) & (np.bitwise_count(parity[js] ^ parity[i]) <= 4 * threshold)
        return [j for j in js[near].tolist() if within(lines[i], lines[j], threshold)]

    return prepare, linked


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, threshold: int = THRESHOLD, short: bool = False) -> DataFrame:
    """One row per line of ``least`` code points or more, and with ``short`` per line of
    any length, of which the shorter ones are joined only where they are equal: doc_id, line_no (from 0),
    class_doc_id and class_line_no (the first line, by document and number, of those
    joined to it by chains of lines within ``threshold`` edits), n_links (different
    texts within ``threshold`` edits of this one), and keep (it is that first line).

    Null texts have no lines, an empty one has one empty line. Lines end at ``\\n`` alone. Rows that repeat a
    document's id and text count as one: all of them keep what the first keeps. Lines of
    documents with a null id stand first, and documents that share an id by their text.
    """
    return _told(docs, id_col, text_col, least, threshold, short).drop("t1", "class_t1", "size")


def _told(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST, threshold: int = THRESHOLD, short: bool = False) -> DataFrame:
    """``line_classes`` with t1 and class_t1, which tell documents that share an id from one
    another, and the line's size."""
    bound_batches(docs.sparkSession)
    lines = line_keys(docs, id_col, text_col, 0 if short else least)
    equal = written(lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "t1", "line_no")).alias("first"), F.max("size").alias("size")), "lines")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(_text(text_col)).alias("t1"), F.split(_text(text_col), "\n", -1).alias("t"))

    def fetch(ids: DataFrame) -> DataFrame:
        """Rows of ``ids`` (k1 and more) with k2 and the line."""
        rest = [c for c in ids.columns if c != "k1"]
        asked = equal.join(ids, "k1").select("first.doc_id", "first.t1", "first.line_no", "k1", "k2", *rest)
        found = asked.join(texts, asked["doc_id"].eqNullSafe(texts["doc_id"]) & (asked["t1"] == texts["t1"])).select("k1", "k2", *rest, F.get("t", "line_no").alias("line"))
        # Rows that repeat a document give the line again.
        return found.filter((F.xxhash64("line") == F.col("k1")) & (F.xxhash64(F.lit(3), "line") == F.col("k2")))

    members = written(_candidates(docs, text_col, least, threshold), "line-members")
    members = _refined(members, fetch, threshold)
    sizes = equal.groupBy(F.col("k1").alias("id")).agg(F.max("size").alias("weight"))
    met = shared_buckets(members.join(sizes, "id").select("bucket", "id", "weight"), BLOCK)
    found = fetch(met.withColumnRenamed("id", "k1"))
    key = F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0"))
    prepare, linked = _verifier(threshold)
    near = classes(link(found.select(key.alias("key"), "buckets", "line"), "key", "buckets", "line", prepare, linked))
    near = equal.select(key.alias("key"), "k1", "k2", "first").join(near, "key")
    near = written(near.select("k1", "k2", "first", "n_links", "root"), "line-links")
    least_of = near.groupBy("root").agg(F.min("first").alias("class"))
    near = near.join(least_of, "root").select("k1", "k2", "class", "n_links")
    told = equal.join(near, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("class", "first").alias("class"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    # Written, so that the join below has an exchange on either side: then the key of a
    # line that most documents have can be split.
    told = written(told, "line-classes")
    return lines.join(told, ["k1", "k2"]).select(
        "doc_id", "t1", "line_no", "size", F.col("class.doc_id").alias("class_doc_id"), F.col("class.t1").alias("class_t1"), F.col("class.line_no").alias("class_line_no"), "n_links",
        (F.col("doc_id").eqNullSafe(F.col("class.doc_id")) & (F.col("t1") == F.col("class.t1")) & (F.col("line_no") == F.col("class.line_no"))).alias("keep"),
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copy: float = COPY, **options) -> DataFrame:
    """``docs`` without lines that repeat an earlier one: short ones exactly, others also
    nearly. Blank lines stay between the others.

    A document goes of which ``copy`` or more of all characters are lines that stand first
    in one and the same other document: it is a copy with changes, and the changed lines
    alone would look like a text of their own. So does one that loses lines and has no word
    in those left. One that loses none stays as it is. Null texts stay.
    """
    repeats = _told(docs, id_col, text_col, **{"short": True} | options).filter("not keep")
    other = ~(F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("t1") == F.col("class_t1")))
    by_source = repeats.groupBy("doc_id", "t1", "class_doc_id", "class_t1").agg(F.collect_set("line_no").alias("gone"), F.sum(F.when(other, F.col("size"))).alias("same"))
    gone = by_source.groupBy("doc_id", "t1").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.max("same").alias("same"))
    own, hashed, lost, same = fresh(docs, "own_id"), fresh(docs, "own_hash"), fresh(docs, "lost"), fresh(docs, "same")
    gone = gone.select(F.col("doc_id").alias(own), F.col("t1").alias(hashed), F.col("gone").alias(lost), F.col("same").alias(same))
    joined = docs.join(gone, docs[id_col].cast("bigint").eqNullSafe(gone[own]) & (F.xxhash64(docs[text_col].cast("string")) == gone[hashed]), "left")
    all_lines = F.split(_text(text_col), "\n", -1)
    kept = F.filter(all_lines, lambda x, i: ~x.rlike(r"\S") | ~F.array_contains(lost, i))
    # Repeats of blank lines alone are no loss.
    whole = F.col(lost).isNull() | (F.size(kept) == F.size(all_lines))
    text = F.when(whole, F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    size = F.length(F.regexp_replace(F.col(text_col).cast("string"), "\n", ""))
    left = whole | (F.exists(kept, lambda x: x.rlike(_WORD)) & (F.coalesce(F.col(same), F.lit(0)) < F.lit(copy) * size))
    return joined.filter(left).select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents"), short=True)
