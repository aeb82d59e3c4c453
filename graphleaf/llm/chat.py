"""Chat formatting by event-sourced reconstruction.

A log holds events of messages: ``message`` opens one with its role and text,
``delta`` appends streamed text, ``edit`` replaces the text, ``regenerate`` empties it
for the deltas that follow. The log is partitioned by conversation and sorted by
message and sequence, so each task folds one message at a time and holds no more than
that and the part it is writing, however long a conversation is.

A conversation is written in parts of whole turns (one part, unless it is longer than
``PART_CHARS``) with the spans of the loss mask: the texts of assistant turns. A turn
reads ``<|im_start|>role``, a line break, the text, ``<|im_end|>``, a line break. Control
strings inside roles and texts get a backslash after their first character, one more
than they already have there, which reading back takes away again; no escaped text
holds a control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphleaf.llm.common import in_small_batches, released, table

START, END = "<|im_start|>", "<|im_end|>"
#: Strings with a meaning for common chat templates.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>")
PART_CHARS = 1 << 20
TRAINED_ROLE = "assistant"

# A control string, with any number of backslashes after its first character; "<<" counts one "<" as that first character.
_REST = "|".join(sorted((re.escape(c[1:]) for c in CONTROL), key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_REST})")
_MARKED = re.compile(rf"([<\[])\\(\\*)(?={_REST})")
_TURN = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1\2", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold(events: Iterable[tuple[str, str | None, str | None]]) -> tuple[str, str]:
    """Role and final text of one message from its (event, role, text) in order; text kept in a list so that deltas cost their own length."""
    role, parts = "", []
    for event, own_role, text in events:
        role = own_role or role
        if event in ("message", "edit", "regenerate"):
            parts.clear()
        parts.append(text or "")
    return role, "".join(parts)


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("past", pa.int64())])))])


def format_events(log: DataFrame) -> DataFrame:
    """Final conversations of an event log: ``conv_id, part, turns, formatted, loss_spans`` (code points of ``formatted``).

    ``log`` has conv_id, message (order of messages), tie (tells messages of the same
    number apart), seq (order of events), event, role, text. Null conversation ids form
    one conversation, null texts and roles are empty, an event other than those named is
    taken as a delta, deltas before any ``message`` open one. Rows of a conversation
    follow each other within a partition, parts in order. A very long message is in memory as a whole,
    one at a time; repeated events are events each; an empty log gives no rows; further columns are ignored."""
    order = ["conv_id", "message", "tie", "seq"]
    log = in_small_batches(log).select(F.col("conv_id").cast("long"), "message", "tie", "seq", "event", "role", "text").repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv: object = ()
        part, turns, size, out, spans = 0, 0, 0, [], []

        def close(last: bool) -> None:
            nonlocal part, turns, size, out, spans
            if turns:
                done.append((conv, part, turns, "".join(out), spans))
            part, turns, size, out, spans = 0 if last else part + 1, 0, 0, [], []

        for key, role, text in _messages(batches):
            if key != conv:
                close(True)
                conv = key
            head = f"{START}{_role_out(role)}\n"
            body = escape(text)
            if role == TRAINED_ROLE:
                spans.append({"start": size + len(head), "past": size + len(head) + len(body)})
            out += (head, body, f"{END}\n")
            size += len(head) + len(body) + len(END) + 1
            turns += 1
            if size > PART_CHARS:
                close(False)
            if len(done) >= 1000 or size == 0:
                yield _batch(done, _FORMATTED)
                done = []
        close(True)
        if done:
            yield _batch(done, _FORMATTED)

    return log.mapInArrow(released(run), "conv_id long, part int, turns long, formatted string, loss_spans array<struct<start: long, past: long>>")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
    """(conversation, role, text) of each folded message of sorted events."""
    key: object = None
    events: list[tuple] = []
    for batch in batches:
        for conv, message, tie, _, event, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if events and ((conv, message, tie) != key or event == "message"):
                yield key[0], *fold(events)
                events = []
            key = (conv, message, tie)
            if event in ("message", "edit", "regenerate"):  # what came before is only needed for the role
                events = [("delta", next((r for _, r, _ in reversed(events) if r), None), None)] if events else []
            events.append((event, role, text))
    if events:
        yield key[0], *fold(events)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text of ``format_events``' output, a row for each conversation; reads only ``formatted`` and ``loss_spans``.

    The parts of a conversation are expected as ``format_events`` gives them, whatever their length; an empty frame gives no rows; further columns are ignored."""
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = ()
        n, chars, loss_chars, turns_hash, loss_hash = 0, 0, 0, None, None
        done = []
        for batch in batches:
            for key, part, _, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != conv or part == 0:
                    if conv != ():
                        done.append((conv, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars))
                    conv, n, chars, loss_chars, turns_hash, loss_hash = key, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                for m in _TURN.finditer(text):
                    n += 1
                    turns_hash.update(f"{_role_in(m[1])}\n{unescape(m[2])}\n".encode())
                for s in spans:
                    plain = unescape(text[s["start"] : s["past"]])
                    loss_chars += len(plain)
                    loss_hash.update(plain.encode())
            if done:
                yield _batch(done, schema)
                done = []
        if conv != ():
            yield _batch([(conv, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars)], schema)

    return formatted.mapInArrow(released(run), kind)


#: Characters of a text that order turns of the same number, before its hash does.
TIE_CHARS = 64


def log_of_turns(turns: DataFrame) -> DataFrame:
    """An event log whose fold is a table of finished turns (conv_id, turn, role, text), as a chat service would have written it.

    An assistant's turn is opened without text, streamed in two deltas of which the first is
    regenerated; any other turn is opened with half its text, which an edit replaces by the
    whole. Null texts and roles are empty. Turns of the same number come in order of role and
    text (its first ``TIE_CHARS`` characters, then its hash); repeated rows are turns each, as
    are those of one hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    head, tail, none = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)), F.lit(None).cast("string")
    event = lambda seq, name, part, own=none: F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("event"), own.alias("role"), part.alias("text"))
    streamed = F.array(event(0, "message", none, role), event(1, "delta", head), event(2, "regenerate", none), event(3, "delta", head), event(4, "delta", tail))
    edited = F.array(event(0, "message", head, role), event(1, "edit", text))
    tie = F.concat(role, F.lit("\n"), F.substring(text, 1, TIE_CHARS), F.hex(F.xxhash64(text)))
    copy = F.monotonically_increasing_id()  # tells repeated rows apart, in no order that shows
    events = turns.select("conv_id", F.col("turn").cast("long").alias("message"), F.struct(tie.alias("order"), copy.alias("copy")).alias("tie"), F.when(role == TRAINED_ROLE, streamed).otherwise(edited).alias("events"))
    return events.select("conv_id", "message", "tie", F.explode("events").alias("e")).select("conv_id", "message", "tie", "e.*")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that is written in control strings, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_events(log_of_turns(turns)))


def _sql_escaped(column: str) -> str:
    return rf"regexp_replace({column}, '([<\[])(\\*)({_REST})', '\1\\\2\3', 'g')"


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{TRAINED_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length(role) + length({_sql_escaped("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
