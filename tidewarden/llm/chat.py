"""Chat formatting by prefix-target expansion: each assistant turn becomes an example of its own, with all preceding turns
as context and only that reply trainable.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|`` (in roles a line feed becomes ``\\n``), so no control string can appear there and the change can be undone.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
#: Characters of examples that a task hands on at once.
FLUSH_CHARS = 4_000_000
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return text if "\\" not in text else _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def expand(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, example, n_turns, formatted, loss_start, loss_end): the code points from loss_start up to loss_end
    of ``formatted`` are trainable, which is the last turn's text and nothing else.

    Rows go by turn, equal turns by role, then text, null turns first; null roles and texts are empty; conversation ids may
    have any type, and each row without one is a conversation of its own; repeated rows are turns each. Turns that no reply follows come as a last example without
    a loss (loss_start and loss_end null), so that every turn is in the output. The conversations are sorted and
    streamed: a task holds one conversation's text so far, never its examples."""
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    rows = rows.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "alone", "turn", "role", "text")
    key = rows.schema["conv_id"].dataType
    kind = pa.schema([("conv_id", to_arrow_type(key)), ("example", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.large_string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def examples(batches):
        now, begun, so_far, n, made, open_turns = None, False, "", 0, 0, False
        out: list[tuple] = []
        chars = 0

        def flush():
            nonlocal out, chars
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind.field(i).type) for i in range(6)], schema=kind)
            out, chars = [], 0
            return batch

        for batch in batches:
            for conv_id, _, who, what in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not begun or conv_id != now or conv_id is None:
                    if open_turns:
                        out.append((now, made, n, so_far, None, None))
                        chars += len(so_far)
                    now, begun, so_far, n, made, open_turns = conv_id, True, "", 0, 0, False
                head = f"{START}{escape_role(who)}\n"
                body = escape(what)
                at = len(so_far) + len(head)
                so_far += f"{head}{body}{END}\n"
                n += 1
                open_turns = who != TRAINED
                if not open_turns:
                    out.append((now, made, n, so_far, at, at + len(body)))
                    made, chars = made + 1, chars + len(so_far)
                if chars > FLUSH_CHARS:
                    yield flush()
        if open_turns:
            out.append((now, made, n, so_far, None, None))
        yield flush()

    return rows.mapInArrow(examples, f"conv_id {key.simpleString()}, example int, n_turns long, formatted string, loss_start long, loss_end long")


def digests(examples: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples) read back from the
    output of :func:`expand`, whose rows must still be in its order: turns from the last and longest example of each
    conversation, losses from the mask of every example; formatted_chars adds up all examples."""
    key = examples.schema["conv_id"].dataType
    fields = [("conv_id", to_arrow_type(key)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())]

    def read(batches):
        now, last, loss, loss_chars, chars, n = None, None, hashlib.sha256(), 0, 0, 0

        def close():
            turns = parse(last)
            digest = hashlib.sha256()
            for who, what in turns:
                digest.update(f"{who}\n{what}\n".encode())
            return now, len(turns), digest.hexdigest(), loss_chars, loss.hexdigest(), chars, n

        for batch in batches:
            out = []
            for conv_id, example, formatted, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "example", "formatted", "loss_start", "loss_end")), strict=True):
                if example == 0:
                    if last is not None:
                        out.append(close())
                    now, loss, loss_chars, chars, n = conv_id, hashlib.sha256(), 0, 0, 0
                if start is not None:
                    trained = unescape(formatted[start:end])
                    loss.update(trained.encode())
                    loss_chars += len(trained)
                last, chars, n = formatted, chars + len(formatted), n + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(fields)], names=[x for x, _ in fields])
        rest = [close()] if last is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rest], k) for i, (_, k) in enumerate(fields)], names=[x for x, _ in fields])

    return examples.mapInArrow(read, f"conv_id {key.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
