"""Byte-level BPE encoding and decoding over Arrow batches (tokenizers library).

``encode`` maps the bytes of each text to the byte-level alphabet, splits by
the pattern and merges by rank, all inside the library; ``decode`` maps the
characters of each token back to bytes and joins them, so characters split
over tokens come back whole.

Null text: empty, no ids.  Any length; texts go to the library in slices of a
batch.  Repeated rows each give a row.  An empty table gives an empty table.
Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sondage.llm.base import pick, texts_by_bytes
from sondage.llm.vocab import byte_chars, encoder, load_json, load_ranks


class Decoder:
    """Bytes and text of ids, by the reversed byte table."""

    def __init__(self, tokenizer):
        back = {c: b for b, c in byte_chars().items()}
        vocab = tokenizer.get_vocab()
        self.token = [b""] * (1 + max(vocab.values()))
        for name, i in vocab.items():
            # an added token outside the byte alphabet stands for its own text
            self.token[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()

    def to_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def to_text(self, ids: list[int]) -> str:
        """Bytes that form no character become U+FFFD, as in a cut sequence."""
        return self.to_bytes(ids).decode("utf-8", "replace")

    def offsets(self, ids: list[int]) -> list[tuple[int, int]]:
        """[start, end) of each token in characters; tokens inside one character share its place."""
        data = np.frombuffer(self.to_bytes(ids), np.uint8)
        before = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # characters begun before each byte
        ends = np.cumsum([len(self.token[i]) for i in ids], dtype=np.int64)
        starts = np.append(0, ends[:-1]) if len(ids) else ends
        inside = np.append((data & 0xC0) == 0x80, False)
        return [(int(before[s]) - int(inside[s]), int(before[e])) for s, e in zip(starts, ends)]


def encode(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           offsets: bool = False) -> DataFrame:
    """``id, ids array<int>`` and, if asked for, ``starts``/``ends`` in characters."""
    rows = pick(df, _id=id_col, _text=text_col)
    kind = dict(df.dtypes)[id_col]
    extra = ", starts array<int>, ends array<int>" if offsets else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "spaced", pattern)
        back = Decoder(enc.tokenizer) if offsets else None
        for b in batches:
            for at, texts in texts_by_bytes(b, "_text"):
                ids = [np.frombuffer(x, "<i4") for x in enc(texts)]
                cols = [b.column("_id").slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32()))]
                if back:
                    spans = [back.offsets(i.tolist()) for i in ids]
                    cols += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "starts", "ends"][: len(cols)])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>{extra}")


def decode(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, data binary, text string`` of rows of ids; null ids: empty."""
    rows = pick(df, _id=id_col, _ids=ids_col)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(load_ranks(path, pattern) if pattern else load_json(path))
        for b in batches:
            data = [back.to_bytes(x or []) for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(data, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in data])],
                ["id", "data", "text"])

    return rows.mapInArrow(run, f"id {kind}, data binary, text string")


def digests(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip of every text in one pass: ids by ``encode``'s encoder, bytes by ``decode``'s decoder, as digests."""
    rows = pick(df, _id=id_col, _text=text_col)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "spaced", pattern)
        back = Decoder(enc.tokenizer)
        decimal = [str(i).encode() for i in range(len(back.token))]
        for b in batches:
            for at, texts in texts_by_bytes(b, "_text"):
                n, ids_hex, data_hex = [], [], []
                for raw in enc(texts):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    n.append(len(ids))
                    ids_hex.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest())
                    data_hex.append(hashlib.sha256(back.to_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(data_hex)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
