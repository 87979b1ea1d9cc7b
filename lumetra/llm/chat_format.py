"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, marked turn by turn, and
only that reply under the loss mask. Control strings inside texts are escaped so that no text can open or
close a turn, and ``read_back`` restores turns and the trainable text from the formatted string alone.

Turns are brought together by conversation with one shuffle and streamed in order; one conversation's
context is held at a time.

Defined results: null text or role is empty; a null conv_id is one conversation; equal turn numbers are
ordered by role and text; repeated rows are repeated turns; a conversation without assistant turns has no example.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"
PROBE = f"{CLOSE}{OPEN}assistant ok"


def escape(text: str) -> str:
    """A text that holds no ``<|``; ``unescape`` gives the original back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", lambda m: "\n" if m[1] == "l" else m[1], text)


def render(role: str, text: str) -> tuple[str, str]:
    """What stands before a turn's text, and the escaped text with its end mark."""
    role = escape(role).replace("\n", "\\l")
    return f"{OPEN}{role}\n", escape(text)


def examples(turns: list[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """(formatted, loss start, loss end) for each assistant turn; offsets are code points."""
    context = ""
    for role, text in turns:
        head, body = render(role, text)
        if role == TARGET:
            start = len(context) + len(head)
            yield f"{context}{head}{body}{CLOSE}\n", start, start + len(body)
        context += f"{head}{body}{CLOSE}\n"


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) that a formatted string holds."""
    found = re.findall(rf"(?s){re.escape(OPEN)}(.*?)\n(.*?){re.escape(CLOSE)}\n", formatted)
    return [(unescape(r), unescape(t)) for r, t in found]


def _conversations(conversations: DataFrame, with_probe: bool) -> DataFrame:
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if with_probe:
        rows = [(-1, 0, "user", PROBE), (-1, 1, TARGET, PROBE)]
        own = own.unionByName(own.sparkSession.createDataFrame(rows, own.schema))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _grouped(batches) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Conversations of a partition that is sorted by conv_id."""
    now, turns, any_yet = None, [], False
    for batch in batches:
        for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if any_yet and conv != now:
                yield now, turns
                turns = []
            now, any_yet = conv, True
            turns.append((role, text))
    if any_yet:
        yield now, turns


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_end."""

    def run(batches):
        import pyarrow as pa

        for conv, turns in _grouped(batches):
            for i, (text, start, end) in enumerate(examples(turns)):
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "example": pa.array([i], pa.int32()), "formatted": [text], "loss_start": pa.array([start], pa.int64()), "loss_end": pa.array([end], pa.int64())})

    return _conversations(conversations, False).mapInArrow(run, "conv_id long, example int, formatted string, loss_start long, loss_end long")


def digests(conversations: DataFrame, with_probe: bool = True) -> DataFrame:
    """Per conversation what its formatted examples hold, read back from them.

    The last example holds every turn up to the last reply; turns after it are in no example and are read
    back from their own rendering.
    """

    def run(batches):
        import pyarrow as pa

        out = []
        for conv, turns in _grouped(batches):
            whole, last, total = hashlib.sha256(), 0, 0
            loss, loss_n, text = hashlib.sha256(), 0, ""
            for text, start, end in examples(turns):
                reply = unescape(text[start:end])
                loss.update(reply.encode())
                loss_n += len(reply)
                total += len(text)
            back = read_back(text)
            last = len(back)
            for role, own in turns[last:]:
                head, body = render(role, own)
                back += read_back(f"{head}{body}{CLOSE}\n")
            for role, own in back:
                whole.update(f"{role}\n{own}\n".encode())
            out.append((conv, len(back), whole.hexdigest(), loss_n, loss.hexdigest(), total))
            if len(out) >= 5000:
                yield _digest_batch(pa, out)
                out = []
        yield _digest_batch(pa, out)

    return _conversations(conversations, with_probe).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(pa, rows):
    columns = list(zip(*rows, strict=True)) or [()] * 6
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)
