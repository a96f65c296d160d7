"""Conversations formatted by a compiled template, and read back.

``format_conversations`` sorts each conversation's rows by turn and renders
them through a template (``template``); the text under ``generation`` is what
a model learns, given as spans of code points.  Control strings inside texts
and roles are escaped with a backslash, so ``read_back`` finds the turns again
whatever a text holds.

Rows stream through sorted partitions: neither step holds a conversation.  The
output has one row per conversation, and further rows (``piece`` 1, 2, ...)
for each ``PIECE`` characters of a very long one; spans count from the start
of their piece.

Turns: ascending, null first; equal turns by role and text.  Null text is
empty, null role too.  Rows with a null conversation id form one conversation.
Repeated rows are turns of their own.  An empty table gives an empty table.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from sondage.llm.base import pick
from sondage.llm.template import compile_template

OPEN, CLOSE = "<turn>", "</turn>"
TEMPLATE = (
    "{% for m in messages %}" + OPEN + "{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + CLOSE + "\n{% endfor %}")
PIECE = 1 << 20

_CONTROL = re.compile(r"\\|</?turn>")
_PLAIN = re.compile(r"\\(.)", re.S)
#: What ends a stretch of a formatted text: an escape, a mark or a line's end.
_MARK = re.compile(r"\\.|</?turn>|\n", re.S)


def escape(text: str) -> str:
    """A backslash before each backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


FILTERS = {"escape": escape, "escape_line": escape_line}


def _pieces(rendered: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, learned spans), cut where a piece is full."""
    out, spans, size = [], [], 0
    for text, learned in rendered:
        if learned and text:
            if spans and spans[-1][1] == size:
                spans[-1] = (spans[-1][0], size + len(text))
            else:
                spans.append((size, size + len(text)))
        out.append(text)
        size += len(text)
        if size >= PIECE:
            yield "".join(out), spans
            out, spans, size = [], [], 0
    if size:
        yield "".join(out), spans


def format_conversations(df: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, piece, text, spans``; pieces of a conversation stay in one partition, in order."""
    rows = pick(df, _conv=conv_col, _turn=turn_col, _role=role_col, _text=text_col)
    kind = dict(df.dtypes)[conv_col]
    schema = pa.schema([("conv_id", to_arrow_type(df.schema[conv_col].dataType)), ("piece", pa.int64()), ("text", pa.string()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        each = (r for b in batches for at in range(0, b.num_rows, 1000) for r in b.slice(at, 1000).to_pylist())
        out, size = [], 0
        for conv, turns in groupby(each, lambda r: r["_conv"]):
            messages = ({"role": r["_role"] or "", "text": r["_text"] or ""} for r in turns)
            for k, (text, spans) in enumerate(_pieces(render({"messages": messages}))):
                out.append({"conv_id": conv, "piece": k, "text": text, "spans": [{"start": a, "stop": b} for a, b in spans]})
                size += len(text)
                if size >= PIECE:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return (rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")
            .mapInArrow(run, f"conv_id {kind}, piece long, text string, spans array<struct<start: long, stop: long>>"))


class Reader:
    """Turns and learned text of a formatted conversation, piece by piece."""

    def __init__(self):
        self.turns = self.chars = self.learned = 0
        self.turn_hash, self.learned_hash = hashlib.sha256(), hashlib.sha256()
        self.state, self.rest = "between", ""

    def _put(self, text: str) -> None:
        if text:
            self.turn_hash.update(unescape(text).encode())

    def feed(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for s in spans:  # a piece ends after a whole value, so no escape is cut
            value = unescape(text[s["start"] : s["stop"]])
            self.learned += len(value)
            self.learned_hash.update(value.encode())
        at = 0
        for m in _MARK.finditer(text):
            mark = m[0]
            if self.state == "between" and mark == OPEN:
                self.state, at, self.turns = "role", m.end(), self.turns + 1
            elif self.state == "role" and mark == "\n":
                self._put(text[at : m.start()])
                self.turn_hash.update(b"\n")
                self.state, at = "text", m.end()
            elif self.state == "text" and mark == CLOSE:
                self._put(text[at : m.start()])
                self.turn_hash.update(b"\n")
                self.state, at = "between", m.end()
        if self.state != "between":
            self._put(text[at:])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: turns, learned text, length.

    Reads pieces in the order in which ``format_conversations`` leaves them.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((b.slice(k, 1)) for b in batches for k in range(b.num_rows))
        rows = ({"conv": p.column("conv_id"), "key": p.column("conv_id")[0].as_py(), "text": p.column("text")[0].as_py(),
                 "spans": p.column("spans")[0].as_py(), "piece": p.column("piece")[0].as_py()} for p in pieces)
        out = []

        def batch() -> pa.RecordBatch:
            keys = pa.concat_arrays([o[0] for o in out])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([keys, *[pa.array([o[k + 1] for o in out], t) for k, t in enumerate(kinds)]], names)

        for _, group in groupby(rows, lambda r: r["key"]):
            reader, first = Reader(), None
            for r in group:
                first = r["conv"] if first is None else first
                reader.feed(r["text"], r["spans"])
            out.append((first, reader.turns, reader.turn_hash.hexdigest(), reader.learned, reader.learned_hash.hexdigest(), reader.chars))
            if len(out) >= 1000:
                yield batch()
                out = []
        if out:
            yield batch()

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
