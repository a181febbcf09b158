"""Chat formatting from event logs.

A log has one row per event: conv_id, message (names a message in its conversation), place (where the message stands), seq
(orders the events of a message), kind, role, text. Kinds:

* ``open``: the message begins, with its place, role and possibly first text;
* ``delta``: text is appended;
* ``edit``: text takes the place of all text so far;
* ``regenerate``: all text so far is dropped; the deltas that follow build the new version.

``fold`` deals the log by (conversation, message), sorts by seq and folds each message in one pass that holds one message, so
that a conversation with a third of all events is spread over many tasks. ``render`` turns each final message into

    <|start|>role<|message|>text<|end|>

and marks under ``loss_start`` and ``loss_end`` (code points of the row) the text of assistants. Control strings inside roles
and texts get a backslash after their first character; runs of backslashes there grow by one, so ``unescape`` restores every
string. A formatted conversation is the concatenation of its rows by place. ``parse`` reads a row back.

Defined cases: a null text is empty, a null role the empty role, a null conv_id a conversation of its own. Events that repeat
(conv_id, message, seq) count once (the least by kind, role, text). Without an ``open`` a message has a null place and comes
first; of several places, roles the first by seq counts. Other and null kinds change nothing. A null message is a message of its
own. Equal places go by role, then formatted text. An empty log gives no rows; very long texts are pieces of one message
until they are folded. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

START, BODY, END = "<|start|>", "<|message|>", "<|end|>"
#: This template's marks and those of other common templates, which must not appear in a text either.
CONTROL = (START, BODY, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MASKED = "assistant"
PIECE = 512

EVENTS = "conv_id long, message string, place long, seq long, kind string, role string, text string"
MESSAGES = "conv_id long, place long, role string, text string"
ROWS = "conv_id long, place long, role string, formatted string, loss_start long, loss_end long"


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def pattern(control: tuple[str, ...] = CONTROL) -> re.Pattern:
    """A control string with any number of backslashes after its first character.

    Escapes are reversible as long as no control string holds another or ends with the beginning of one, and none has a
    backslash.
    """
    for a in control:
        if len(a) < 2 or "\\" in a or any((b != a and b in a) or any(b.startswith(a[i:]) for i in range(1, len(a))) for b in control):
            raise ValueError(f"control string {a!r} is too short, has a backslash, or holds or overlaps another")
    return re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in control))


_CONTROL = pattern()


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def log_of(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log: each row opens a message and streams its text in pieces."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("place"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.monotonically_increasing_id().cast("string"))
    events = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.length("text") / piece))).alias("seq"))
    opening = F.col("seq") == 0
    return events.select(
        "conv_id", "message", F.when(opening, F.col("place")).alias("place"), "seq", F.when(opening, "open").otherwise("delta").alias("kind"),
        F.when(opening, F.col("role")).alias("role"), F.when(~opening, F.substring("text", ((F.col("seq") - 1) * piece + 1).cast("int"), F.lit(piece))).alias("text"),
    )


def fold(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, place, role, text."""
    log = log.select(*(F.col(n).cast(k).alias(n) for n, k in (c.split(" ") for c in EVENTS.split(", "))))
    dealt = log.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, place, role, text = None, None, None, None, []
        out, size = [], 0
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], _names(MESSAGES))
        for part in slices(batches, "text"):
            for conv_id, message, at, seq, kind, who, what in zip(*(part.column(n).to_pylist() for n in _names(EVENTS)), strict=True):
                if key != (conv_id, message):
                    if key is not None:
                        out.append((key[0], place, role or "", "".join(text)))
                        size += len(out[-1][3])
                    key, place, role, text = (conv_id, message), None, None, []
                    if size > 1_000_000 or len(out) >= 10_000:
                        yield as_batch()
                        out, size = [], 0
                elif seq == last:
                    continue
                last = seq
                if kind == "open" and place is None:
                    place = at
                if role is None:
                    role = who
                if kind in ("edit", "regenerate"):
                    text = []
                if kind in ("open", "delta", "edit") and what:
                    text.append(what)
        if key is not None:
            out.append((key[0], place, role or "", "".join(text)))
        if out:
            yield as_batch()

    return dealt.mapInArrow(run, MESSAGES)


def render(messages: DataFrame) -> DataFrame:
    """Formatted text of each message and the span under the loss mask (null if there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            roles = [r or "" for r in batch.column("role").to_pylist()]
            heads = [f"{START}{escape(r)}{BODY}" for r in roles]
            texts = [escape(t or "") for t in batch.column("text").to_pylist()]
            spans = [(len(h), len(h) + len(t)) if r == MASKED else (None, None) for r, h, t in zip(roles, heads, texts, strict=True)]
            formatted = pa.array([f"{h}{t}{END}" for h, t in zip(heads, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("place"), pa.array(roles, pa.string()), formatted, pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64())], _names(ROWS)
            )

    return messages.select(*_names(MESSAGES)).mapInArrow(run, ROWS)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted row."""
    head, body = formatted[len(START) : -len(END)].split(BODY)
    return unescape(head), unescape(body)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(rows: DataFrame) -> DataFrame:
    """What each formatted conversation says when read back: a running digest of its turns and of its masked text.

    A digest is a chain, so a conversation passes through one task in order; the task holds one row of it at a time.
    """
    dealt = rows.select(*_names(ROWS)).repartition("conv_id").sortWithinPartitions("conv_id", "place", "role", "formatted")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, loss, counts = None, None, None, [0, 0, 0]
        out = []
        done = lambda: (key[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])
        for part in slices(batches, "formatted"):
            for conv_id, formatted, start, end in zip(*(part.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if key is None or key[0] != conv_id:
                    if key is not None:
                        out.append(done())
                    key, turns, loss, counts = (conv_id,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                role, text = parse(formatted)
                turns.update(f"{role}\n{text}\n".encode())
                counts[0] += 1
                counts[2] += len(formatted)
                if start is not None:
                    masked = unescape(formatted[start:end])
                    loss.update(masked.encode())
                    counts[1] += len(masked)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], _names(DIGESTS))
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(done(), kinds, strict=True)], _names(DIGESTS))

    return dealt.mapInArrow(run, DIGESTS)
