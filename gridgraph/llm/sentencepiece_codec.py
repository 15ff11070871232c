"""Exact encoding with a merge-type SentencePiece model by backtracking, and decoding.

For every position of a chunk, one Aho-Corasick pass over the reversed chunk gives the
longest piece that starts there. Pieces are then taken greedily; one is kept if it is
compatible with the piece before it, that is, if merging the two pieces' characters
again by score gives just these two pieces. Else its next shorter prefix is tried, and
when none is left, the position is marked in a bitfield of failed positions and the
last piece is taken back. A sequence whose neighbours are all compatible is the one that
merging the whole chunk gives, so the result equals the library's.

No piece of such a model holds a mark of a blank behind another character, and merges
need a piece that holds both sides: a text falls apart exactly into chunks, and chunks
into parts, wherever two neighbouring characters stand together in no piece. Chunks
repeat, so their encodings are kept in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgraph.llm.common import as_bytes, bound_batches, sliced, table

MARK = "▁"
_LETTER = re.compile(r"[^\W\d_]")
#: Entries in each of the two tables of chunks, and in the table of piece pairs, of a worker.
CHUNKS, PAIRS = 160_000, 250_000
_NO_MERGE = float("-inf")


class Codec:
    """Encoder and decoder of one model, given by the bytes of its file."""

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        if lib.normalize(" a½ﬁ") != f"{MARK}{MARK}a½ﬁ":
            raise ValueError("only models with identity normalization and a dummy prefix are covered")
        self.end = lib.eos_id()
        self.names, self.kinds, scores = [], [], {}
        self.byte_ids: dict[int, int] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            kind = "byte" if lib.is_byte(i) else "unknown" if lib.is_unknown(i) else "control" if lib.is_control(i) else "unused" if lib.is_unused(i) else "piece"
            self.names.append(piece)
            self.kinds.append(kind)
            if kind == "byte":
                self.byte_ids[int(piece[3:-1], 16)] = i
            elif kind == "piece":
                scores[piece] = (lib.get_score(i), i)
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece holds a blank behind another character")
        self.scores = scores
        self.order = {p: score for p, (score, _) in scores.items()}
        self.joined = {p[k : k + 2] for p in scores for k in range(len(p) - 1)}
        self.chunk = re.compile(self._chunk_pattern())
        self.unknown = lib.unk_id()
        # Pieces that merging their own characters can't make never come out.
        self.made = [p for p in scores if len(p) == 1 or self.merge(p) == [p]]
        self._ready = False

    def _chunk_pattern(self) -> str:
        """Besides before a mark, a text falls apart for certain between a letter and a
        character that stands behind a letter in no piece, and behind a character that
        stands before another in no piece. Words without their punctuation repeat more."""
        before: dict[str, set[str]] = {}
        for a, b in self.joined:
            before.setdefault(b, set()).add(a)
        first = {p[0] for p in self.joined}
        ends = [c for c in map(chr, range(0x80)) if not _LETTER.match(c)]
        free = "".join(re.escape(c) for c in ends if c not in before)
        held = "".join(f"|(?<![{re.escape(''.join(sorted(before[c])))}])(?={re.escape(c)})" for c in ".,;:!?)" if c in before)
        last = "".join(re.escape(c) for c in ends if c not in first)
        line = rf"[^{MARK}\w{last}]*[{last}]+|" if last else ""
        return rf"{MARK}*[^\W\d_]+(?:(?=[{free}{MARK}]|\Z){held})|{line}{MARK}*[^{MARK}]+|{MARK}+"

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "chunks", "older", "pairs", "shorter", "coded")} | {"_ready": False}

    def _prepare(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for p in self.made:
            self.automaton.add_word(p[::-1], p)
        self.automaton.make_automaton()
        known = set(self.made)
        self.coded = {p: (str(self.scores[p][1]), p.replace(MARK, " ")) for p in self.made}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), p[0] if len(p) > 1 else None) for p in self.made}
        self.chunks: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self._ready = True

    def merge(self, text: str) -> list[str]:
        """Merging by score from single characters; the leftmost of equals first."""
        return self._merge(text, -1)

    def _merge(self, text: str, border: int) -> list[str]:
        """Merged parts; none as soon as a merge would take in the first ``border``
        characters' last part and the part behind it."""
        get, none = self.order.get, _NO_MERGE
        parts = list(text)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == none:
                break
            k = scores.index(best)
            if k == border - 1:
                return []
            if k < border:
                border -= 1
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of both again gives the two pieces."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._merge(a + b, len(a)) == [a, b]
        return known

    def pieces(self, part: str) -> list[str]:
        """The pieces of a text without certain boundaries, by backtracking."""
        n = len(part)
        longest = list(part)  # a character that no piece covers stands for itself
        for last, piece in self.automaton.iter(part[::-1]):
            k = n - 1 - last
            if len(piece) > len(longest[k]):
                longest[k] = piece
        failed = bytearray(n // 8 + 1)  # a bit for each position
        out: list[str] = []
        pairs, shorter, compatible = self.pairs, self.shorter, self.compatible
        at, piece = 0, longest[0]
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = not out or pairs.get((out[-1], piece))
                if fits is None:
                    fits = compatible(out[-1], piece)
                if fits:
                    out.append(piece)
                    at = end
                    if at == n:
                        return out
                    piece = longest[at]
                    continue
            piece = shorter.get(piece)
            while piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                piece = shorter.get(last)

    def parts(self, chunk: str) -> Iterator[str]:
        begin = 0
        for k in range(len(chunk) - 1):
            if chunk[k : k + 2] not in self.joined:
                yield chunk[begin : k + 1]
                begin = k + 1
        yield chunk[begin:]

    def _part(self, part: str) -> tuple[int, str, str]:
        own = self.coded.get(part)
        if own is not None:
            return 1, *own
        found = self.pieces(part) if len(part) > 1 else [part]
        coded = [self.coded.get(piece) for piece in found]
        if None not in coded:
            return len(coded), " ".join([c[0] for c in coded]), "".join([c[1] for c in coded])
        ids: list[int] = []
        for piece, code in zip(found, coded, strict=True):
            ids += [int(code[0])] if code else [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]
        return len(ids), " ".join(map(str, ids)), self._text(ids)

    def _entry(self, chunk: str, parts: list[str]) -> tuple[int, str, str]:
        """Number of ids, the ids as text, and the decoded text of a chunk. It is kept; a
        full table becomes the older one, from which chunks in use return."""
        entry = self.older.get(chunk)
        if entry is None:
            if len(parts) == 1:
                entry = self._part(chunk)
            else:
                each = [self.chunks.get(p) or self._entry(p, [p]) for p in parts]
                entry = sum([x[0] for x in each]), " ".join([x[1] for x in each]), "".join([x[2] for x in each])
        if len(chunk) <= 64:
            if len(self.chunks) >= CHUNKS:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = entry
        return entry

    def split(self, text: str) -> list[tuple[int, str, str]]:
        if not self._ready:
            self._prepare()
        if not text:
            return []
        out = []
        for c in self.chunk.findall(MARK + text.replace(" ", MARK)):
            entry = self.chunks.get(c)
            out.append(self._entry(c, list(self.parts(c))) if entry is None else entry)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text, with the end id behind them."""
        return [int(i) for _, ids, _ in self.split(text) for i in ids.split()] + [self.end]

    def _text(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == "byte":
                run.append(int(self.names[i][3:-1], 16))
                continue
            while run:  # a byte that begins no character reads as U+FFFD
                n = next((n for n in (1, 2, 3, 4) if _valid(bytes(run[:n]))), 0)
                out.append(bytes(run[:n]).decode() if n else "�")
                del run[: n or 1]
            if i is not None and self.kinds[i] != "control":
                out.append(" ⁇ " if self.kinds[i] == "unknown" else self.names[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the blank that encoding puts before a text."""
        text = self._text(ids)
        first = next((i for i in ids if self.kinds[i] != "control"), None)
        return text[1:] if first is not None and self.names[first].startswith(MARK) else text


def _valid(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array<int>, unless ids=False), ``n_tokens``, ``ids_sha256``
    and ``decoded_sha256``, in place of columns of those names.

    A null or empty text has the end id alone and decodes to an empty text. Repeated rows
    each get their own result. The model file is read by the driver.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(Codec(f.read()))
    made = (["ids"] if ids else []) + ["n_tokens", "ids_sha256", "decoded_sha256"]
    rest = docs.select(*[c for c in docs.columns if c not in made and c != text_col], F.col(text_col).alias(text_col))
    names = [c for c in docs.columns if c not in made] if text_col not in made else None
    keep_text = ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        sha = hashlib.sha256
        for batch in sliced(batches, 500):
            texts = as_bytes(batch.column(batch.num_columns - 1))
            all_ids, n, digests, decoded = [], [], [], []
            for t in texts:
                parts = codec.split(t.decode("utf-8", "replace") if t else "")
                if ids:
                    all_ids.append([int(i) for x in parts for i in x[1].split()] + [codec.end])
                n.append(sum([x[0] for x in parts]) + 1)
                digests.append(sha(" ".join([*[x[1] for x in parts], str(codec.end)]).encode()).hexdigest())
                decoded.append(sha("".join([x[2] for x in parts])[1:].encode()).hexdigest())
            columns = list(batch.columns) if keep_text else list(batch.columns[:-1])
            columns += ([pa.array(all_ids, pa.list_(pa.int32()))] if ids else []) + [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=out_schema)

    kept = rest if keep_text else rest.drop(text_col)
    full = kept.select("*", *([F.lit(None).cast("array<int>").alias("ids")] if ids else []), F.lit(0).cast("bigint").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"))
    out_schema = full.columns
    out = rest.mapInArrow(run, full.schema)
    return out.select(*[c for c in names if keep_text or c != text_col], *made)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, model_path or default_model(), ids=False)
