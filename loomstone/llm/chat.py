"""Chat formatting (operator 3): prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its reply is trainable. Turns that follow the last assistant
turn (all turns, where there is none) make one more example without a target,
so no turn is lost.

A turn reads ``<|role|>\\ntext<|end|>\\n``. Inside roles and texts ``&``,
``<``, ``>`` and ``[`` are escaped, so neither this template's control strings nor common
ones of others (``</s>``, ``[INST]``) can arise from a text; unescaping gives
the text back exactly.

Turns are sorted by conversation inside partitions and streamed, so a task
holds one conversation at a time; one conversation is one task's work, as each
example continues the one before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import arrow, table

TARGET_ROLE = "assistant"
FLUSH_CHARS = 4 << 20  # characters of examples in one output batch

_EXAMPLES = "conv_id bigint, example bigint, formatted string, loss_start bigint, loss_end bigint"
_TURN = re.compile(r"<\|([^<>]*)\|>\n([^<>]*)<\|end\|>\n")


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("[", "&lsqb;")


def unescape(text: str) -> str:
    return text.replace("&lsqb;", "[").replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its text begins and ends."""
    head, body = f"<|{escape(role)}|>\n", escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from an example."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def expand(turns: list[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """(formatted, loss start, loss end) of each example of a conversation; an empty mask has start = end."""
    parts, size, open_ = [], 0, False
    for role, text in turns:
        turn, begin, end = format_turn(role, text)
        parts.append(turn)
        open_ = role != TARGET_ROLE
        if not open_:
            parts = ["".join(parts)]
            yield parts[0], size + begin, size + end
        size += len(turn)
    if open_:
        yield "".join(parts), 0, 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ["conv_id", "example", "formatted", "loss_start", "loss_end"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _expand_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, turns, rows, chars, seen = None, [], [], 0, False

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal rows, chars
        for i, (formatted, begin, end) in enumerate(expand(turns)):
            rows.append((now, i, formatted, begin, end))
            chars += len(formatted)
            if chars > FLUSH_CHARS:
                yield _batch(rows)
                rows, chars = [], 0

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if seen and conv != now:
                yield from flush()
                turns = []
            now, seen = conv, True
            turns.append((role, text))
    if turns:
        yield from flush()
    if rows:
        yield _batch(rows)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end) for each example of ``turns``.

    ``turns`` has conv_id, turn, role and text; turns go by ``turn`` (nulls
    first), then role and text, and repeated rows are all kept. Null roles and
    texts count as empty. Rows with a null conv_id make one conversation. The
    mask is a code point range of ``formatted``, empty where there is no
    target. Other columns are ignored; an empty table gives no examples.
    """
    plain = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return arrow(dealt.select("conv_id", "role", "text"), _expand_sorted, _EXAMPLES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive examples of a conversation -> what they hold, read back."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    now, last, seen = None, "", False
    loss, loss_chars, formatted_chars = hashlib.sha256(), 0, 0

    def row() -> tuple:
        turns = read_turns(last)
        said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
        return now, len(turns), said.hexdigest(), loss_chars, loss.hexdigest(), formatted_chars

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    for batch in batches:
        rows = []
        for conv, formatted, begin, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            if seen and conv != now:
                rows.append(row())
                loss, loss_chars, formatted_chars = hashlib.sha256(), 0, 0
            now, last, seen = conv, formatted, True
            text = unescape(formatted[begin:end])
            loss.update(text.encode())
            loss_chars += len(text)
            formatted_chars += len(formatted)
        yield out(rows)
    if seen:
        yield out([row()])


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return arrow(format_chats(turns), _digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


OP3_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, 13 + len(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&lsqb;'))
              + len(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&lsqb;')) AS size
  FROM c
), r AS (
  SELECT *, sum(size) OVER w AS sofar, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN sofar ELSE 0 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
