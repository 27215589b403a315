"""Chat formatting in budgeted windows.

The rows of a conversation are streamed in turn order; the running sum of turn tokens cuts them into turn-aligned
windows of at most `budget` tokens. A window opens with the conversation's system turn (if its first turn is one) and
with up to `history` tokens of the turns just before it, both repeated for context; only assistant texts that the
window is the first to hold are under its loss mask.

A turn is written as `<turn ROLE>`, a line feed, the text, a line feed and `</turn>`, a line feed. In texts and roles a
backslash goes before each backslash and before each `<turn` and `</turn`, and role line feeds are written `\\n`, so the
marks can't be faked and the text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import batches, small_batches
from .byte_bpe import Tokenizer

_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD, _END = "<turn ", "\n</turn>\n"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn", "\\<turn").replace("</turn", "\\</turn") if "\\" in text or "<" in text else text


def unescape(text: str) -> str:
    # A backslash that isn't one of a pair stands before a mark, so pairs are found from the left.
    return "\\".join([part.replace("\\", "") for part in text.split("\\\\")]) if "\\" in text else text


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n").replace(">", "\\>")


def _unrole(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn as written, and where its text begins in it."""
    head = f"<turn {_role(role)}>\n"
    return f"{head}{escape(text)}{_END}", len(head)


def parse(window: str) -> list[tuple[str, str]]:
    """The turns of a window as (role, text), exactly as they were before formatting."""
    # Written roles hold no line feed and written texts no bare mark, so the first of each ends them.
    out, at = [], 0
    while at < len(window):
        begin = window.find("\n", at) + 1
        end = window.find(_END, begin)
        if not window.startswith(_HEAD, at) or not begin or window[begin - 2] != ">" or end < 0:
            raise ValueError(f"no turn at {at}")
        out.append((_unrole(window[at + len(_HEAD) : begin - 2]), unescape(window[begin:end])))
        at = end + len(_END)
    return out


def chat_windows(rows: DataFrame, tokenizer: Tokenizer, budget: int = 2048, history: int = 512, target: str = "assistant", id_col: str = "conv_id") -> DataFrame:
    """id_col, window_no, text, n_turns, n_repeated (turns at its start that earlier windows hold), n_tokens, loss (spans
    of text, as start and end in code points), in order of window_no within a conversation and partition.

    Rows are (id_col, turn, role, text); null role or text counts as empty, equal turn numbers go by role, then text, and
    repeated rows are turns of their own. Null ids form one conversation. Other columns are not read; an empty table gives
    no windows. A turn that is over the budget, alone or behind the system turn, gets a window of its own, whole, with
    the system turn before it: only such windows exceed the budget. Tasks stream: memory holds one window and the
    history, however long the conversation.
    """
    make = tokenizer.maker()
    kind = rows.schema[id_col].dataType
    source = small_batches(rows).select(F.col(id_col).alias("conv"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = source.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("window_no", pa.int64()), ("text", pa.string()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("loss", span)])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = make()

        def turns():
            for batch in stream:
                convs, roles, texts = (c.to_pylist() for c in batch.columns)
                done = [format_turn(r, t) for r, t in zip(roles, texts)]
                for conv, role, (text, start), ids in zip(convs, roles, done, bpe.encode_batch([d[0] for d in done])):
                    yield conv, role, text, start, len(ids) // 4

        def window(conv, number, repeated, new):
            parts, loss, at = [], [], 0
            for fresh, (role, text, start, _) in [*((False, t) for t in repeated), *((True, t) for t in new)]:
                parts.append(text)
                if fresh and role == target:
                    loss.append({"start": at + start, "end": at + len(text) - len(_END)})
                at += len(text)
            return conv, number, "".join(parts), len(repeated) + len(new), len(repeated), sum(t[3] for t in [*repeated, *new]), loss

        def rows_out():
            begun, conv, number, system, repeated, new, held = False, None, 0, None, [], [], 0
            recent: deque = deque()
            for c, *turn in turns():
                if not begun or c != conv:
                    if new:
                        yield window(conv, number, repeated, new)
                    begun, conv, number, repeated, new, held = True, c, 0, [], [], 0
                    recent.clear()
                    system = turn if turn[0] == "system" else None
                elif new and held + turn[3] > budget:
                    yield window(conv, number, repeated, new)
                    number += 1
                    # The longest run of last turns within the history, as far as the budget leaves room for it.
                    room = budget - turn[3] - (system[3] if system else 0)
                    repeated, left = [], min(history, room)
                    for old in reversed(recent):
                        left -= old[3]
                        if left < 0 or old is system:
                            break
                        repeated.insert(0, old)
                    if system:
                        repeated.insert(0, system)
                    new, held = [], sum(t[3] for t in repeated)
                new.append(turn)
                held += turn[3]
                recent.append(turn)
                while len(recent) > 1 and sum(t[3] for t in recent) - recent[0][3] > history:
                    recent.popleft()
            if new:
                yield window(conv, number, repeated, new)

        return batches(rows_out(), schema, lambda r: 64 + len(r[2]))

    return ordered.mapInArrow(run, f"{id_col} {kind.simpleString()}, window_no long, text string, n_turns int, n_repeated int, n_tokens long, loss array<struct<start:int,end:int>>")


def read_back(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, from chat_windows' rows in their order: n_turns, turns_sha256 (role, \\n, text, \\n of each turn),
    loss_chars and loss_sha256 (all text under the loss masks, unescaped), formatted_chars (of all windows), n_windows."""
    kind = windows.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            conv, state = None, None
            for batch in stream:
                for c, number, text, repeated, loss in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 6))):
                    if state is None or number == 0:
                        if state is not None:
                            yield done(conv, state)
                        conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for role, said in parse(text)[repeated:]:
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                    for span in loss:
                        said = unescape(text[span["start"] : span["end"]])
                        state[2] += len(said)
                        state[3].update(said.encode())
                    state[4] += len(text)
                    state[5] += 1
            if state is not None:
                yield done(conv, state)

        def done(conv, s):
            return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5]

        return batches(rows(), schema, lambda r: 256)

    return windows.mapInArrow(run, f"{id_col} {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
