"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, its reply as the
only trainable text. A conversation whose last turns have no reply behind them gets one
more example, without trainable text, so that no turn is lost.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Control strings of this
and other templates all begin with ``<`` or ``[``; inside roles and texts a backslash is
put behind these two, and backslashes are doubled, so that a text can hold no control
string and reading it back gives the same text. Line ends in roles are escaped too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgraph.llm.common import bound_batches, sliced, table, written

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
_ESCAPED = re.compile(r"\\(.)|([<\[])\\", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or m[2], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1] or m[2], text)


_EXAMPLES = "conv_id bigint, example int, formatted string, loss_start bigint, loss_end bigint"


def expand(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv_id, example (from 1), formatted, and the code points
    ``loss_start`` to ``loss_end`` (without it) of ``formatted`` that are trainable.

    Turns stand in order of turn, then role, then text; a null turn stands first, a null
    role or text is empty. Repeated rows are turns of their own. Rows with a null
    conv_id form a conversation. A task holds one conversation's turns at a time and
    gives out its examples one by one.
    """
    bound_batches(conversations.sparkSession, 500)
    turn = F.struct(F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col(conv_col).cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            rows, size = [], 0
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in _examples(conv, turns):
                    rows.append(row)
                    size += len(row[2])
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
            yield _batch(rows)

    return grouped.mapInArrow(run, _EXAMPLES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _EXAMPLES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)], names=names)


def _examples(conv: int | None, turns: list[dict]) -> Iterator[tuple]:
    context, n, waiting = "", 0, False
    for t in turns:
        head, text = START + escape_role(t["role"]) + MIDDLE, escape(t["text"])
        if t["role"] == "assistant":
            n += 1
            begin = len(context) + len(head)
            yield conv, n, context + head + text + END, begin, begin + len(text)
        waiting = t["role"] != "assistant"
        context += head + text + END
    if waiting:
        yield conv, n + 1, context, len(context), len(context)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.DOTALL)


_READ = "conv_id bigint, example int, n_turns bigint, turns_sha256 string, loss string, formatted_chars bigint"


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from its examples alone: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Each example is read where it is; digests and trainable texts meet by conversation.
    The last example of a conversation holds all of its turns; the trainable texts of
    all examples, in order, are the replies.
    """
    bound_batches(examples.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            columns: list[list] = [[], [], [], []]
            for formatted, start, end in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                turns = _TURN.findall(formatted)
                if sum(len(r) + len(t) + len(START) + len(MIDDLE) + len(END) for r, t in turns) != len(formatted):
                    raise ValueError("an example is not a sequence of turns")
                told = "".join(f"{unescape_role(r)}\n{unescape(t)}\n" for r, t in turns)
                row = (len(turns), hashlib.sha256(told.encode()).hexdigest(), unescape(formatted[start:end]), len(formatted))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns, types)], names=[x.split()[0] for x in _READ.split(", ")])

    each = examples.select("conv_id", "example", "formatted", "loss_start", "loss_end").mapInArrow(run, _READ)
    out = each.groupBy("conv_id").agg(
        F.max_by(F.struct("n_turns", "turns_sha256"), "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    return out.select("conv_id", "whole.n_turns", "whole.turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    added = spark.range(1).selectExpr(f"inline(array(struct(-7L, 0L, 'user', '{own}'), struct(-7L, 1L, 'assistant', '{own}')))").toDF("conv_id", "turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return read_back(written(expand(rows), "chat"))


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(24 + length(text) + 3 * length(role) - length(replace(role, chr(10), '')) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', ''))
      + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', ''))) OVER w AS so_far
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN so_far ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
