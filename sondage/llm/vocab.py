"""Encoding with the tokenizers library, each distinct chunk of a text once.

The pre-tokenizers of both vocabularies never match across the chunk borders
used here, so the ids of a text are those of its chunks in a row:

* ``words``: texts cut at ASCII white space, for a vocabulary that drops
  white space, folds case and never joins over white space;
* ``spaced``: texts cut before each U+0020 that a character other than white
  space follows.  The byte-level pattern always starts a match there: a word
  takes one space before it, and a run of white space leaves its last
  character to the word.

Both also cut at full stops and commas that stand between letters, digits and
white space, and ``spaced`` at single line feeds between visible characters:
there too each side is matched by itself.  A text where one of these stands
beside anything else is cut at spaces only.

New chunks go to the library in rows of ``ROW``, since short calls cost more
than their text; the tokens' bytes, or a separator that is a token of its own,
tell where each ends.  A worker keeps the ids of chunks it has seen, up to
a limit (``LIMIT`` unless an operator sets its own); then it goes on with those it needs just then.  This bounds
memory and changes no result.
"""

from __future__ import annotations

import base64
import gc
import re

import numpy as np

LIMIT = 400_000
ROW = 500
#: Begins a chunk that no space goes before (a byte that UTF-8 has not).
BARE = b"\xff"
#: A space followed by what may be white space (its first byte in UTF-8), or by the end.
_RISK = re.compile(rb" (?=[ \t-\r\x1c-\x1f\xc2\xe1-\xe3]|\Z)")
_BORDER = re.compile(rb" (?![ \t-\r\x1c-\x1f\xc2\xe1-\xe3]|\Z)")
#: Latin letters of two bytes (without the signs for times and divided by).
_LETTER = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
#: A stop or comma (or line feed) beside something else than the module's text allows.
_TIGHT_WORDS = re.compile(
    rb"[.,](?:(?<![0-9a-z\s][.,])(?<!" + _LETTER + rb"[.,])|(?![0-9a-z\s]|" + _LETTER + rb"|\Z))")
_TIGHT = re.compile(
    rb"[.,](?:(?<![0-9A-Za-z][.,])(?<!" + _LETTER + rb"[.,])|(?![0-9A-Za-z \n]|" + _LETTER + rb"|\Z))"
    rb"|\n(?:(?<![!-~]\n)(?<!" + _LETTER + rb"\n)|(?![!-~]|" + _LETTER + rb"))")


def _solid(chunk: bytes) -> bool:
    """Begins and ends with a visible ASCII character."""
    return bool(chunk) and 0x20 < chunk[0] < 0x7F and 0x20 < chunk[-1] < 0x7F


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 as itself, other bytes from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_json(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def load_ranks(path: str, pattern: str):
    """A byte-level BPE tokenizer over a rank file.

    Merging by rank joins any two neighbours whose bytes together are a token,
    the lowest rank first.  So every split of a token into two tokens becomes a
    merge, in the order of the joined token's rank, and a whole match that is
    a token is taken as it is.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    chars = byte_chars()
    tokens = read_ranks(path)
    known = set(tokens)
    name = ["".join(chars[b] for b in t) for t in tokens]
    merges = [(n[:i], n[i:]) for t, n in zip(tokens, name) for i in range(1, len(t)) if t[:i] in known and t[i:] in known]
    t = Tokenizer(models.BPE(vocab={n: i for i, n in enumerate(name)}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.decoder = decoders.ByteLevel()
    return t


class Encoder:
    """Ids of texts as little-endian 32-bit integers in bytes."""

    def __init__(self, tokenizer, cut: str, limit: int):
        from tokenizers import normalizers, pre_tokenizers

        self.tokenizer, self.spaced, self.limit = tokenizer, cut == "spaced", limit
        self.memo: dict[bytes, bytes] = {}  # ids of chunks
        # ASCII letters need no normalising and no pattern: their bytes are their characters
        self.letters = type(tokenizer).from_str(tokenizer.to_str())
        self.letters.encode_special_tokens = True
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        if self.spaced:
            one = {c: 1 for c in byte_chars().values()}
            vocab = tokenizer.get_vocab()
            self.width = np.zeros(1 + max(vocab.values()), np.int64)  # bytes of each token
            for name, i in vocab.items():
                self.width[i] = sum(one.get(c, 0) for c in name)
        else:
            self.bar = tokenizer.encode("|", add_special_tokens=False).ids[0]

    def _chunks(self, text: bytes) -> list[bytes]:
        if not self.spaced:
            text = text.lower()  # A-Z only, which the vocabulary folds anyway
            if not _TIGHT_WORDS.search(text):
                text = text.replace(b".", b" . ").replace(b",", b" , ")
            return text.split()
        if _RISK.search(text):
            return _BORDER.split(BARE + text)
        if not _TIGHT.search(text):
            text = text.replace(b".", b" \xff.").replace(b",", b" \xff,").replace(b"\n", b" \xff\n \xff")
        return (BARE + text).split(b" ")

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _row(self, row: list[bytes], ids: np.ndarray, gap: int) -> list[bytes]:
        """The ids of a row, cut into those of its chunks, which stand ``gap`` bytes apart (negative: so much shorter)."""
        if self.spaced:
            stop = np.cumsum([len(c) + gap for c in row])
            ends = np.cumsum(self.width[ids])
            a, b = np.searchsorted(ends, np.append(0, stop[:-1]), "right"), np.searchsorted(ends, stop - max(gap, 0), "right")
        else:
            bars = np.flatnonzero(ids == self.bar)
            a, b = np.append(0, bars + 1), np.append(bars, len(ids))
        if len(a) != len(row):
            raise ValueError("the tokenizer joined tokens over a border of chunks")
        raw = ids.tobytes()
        return [raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist())]

    def _add(self, chunks: list[bytes], texts: list[bytes], glue: bytes | None, gap: int = 0, tokenizer=None) -> None:
        """Learn chunks by their texts, in rows with ``glue`` (``gap`` bytes of it in the tokens) between, or each alone."""
        size = 1 if glue is None else ROW
        rows = [texts[at : at + size] for at in range(0, len(texts), size)]
        for at in range(0, len(rows), 40 * ROW // size):
            some = rows[at : at + 40 * ROW // size]
            found = self._ids(tokenizer or self.tokenizer, [(glue or b"").join(r).decode() for r in some])
            ids = [i.tobytes() for i in found] if glue is None else [x for r, i in zip(some, found) for x in self._row(r, i, gap)]
            self.memo.update(zip(chunks[at * size :], ids))

    def _learn(self, chunks: set[bytes]) -> None:
        memo = self.memo
        if len(memo) + len(chunks) > self.limit:  # these are all the chunks that are needed next
            now = {c: memo[c] for c in chunks if c in memo}
            memo.clear()
            memo.update(now)
        new = [c for c in chunks if c not in memo]
        letters, other = [c for c in new if c.isalpha()], [c for c in new if not c.isalpha()]
        if self.spaced:
            space = byte_chars()[32].encode()
            self._add(letters, [space + c for c in letters], b" ", 1 - len(space), self.letters)
            led = [c for c in other if c[:1] != BARE]
            self._add(led, [b" " + c for c in led], b"")
            bare = [c for c in other if c[:1] == BARE]
            solid = [c for c in bare if _solid(c[1:])]
            self._add(solid, [c[1:] for c in solid], b"\n", 1)
            alone = [c for c in bare if not _solid(c[1:])]
            self._add(alone, [c[1:] for c in alone], None)
        else:
            plain, alone = [c for c in other if b"|" not in c], [c for c in other if b"|" in c]
            self._add(letters, letters, b" | ", 0, self.letters)
            self._add(plain, plain, b" | ")
            self._add(alone, alone, None)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # many small objects and no cycles: searching for cycles takes a sixth of the time
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        parts = [self._chunks(t) for t in texts]
        self._learn({c for p in parts for c in p})
        get = self.memo.__getitem__
        return [b"".join(map(get, p)) for p in parts]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, cut: str, pattern: str | None = None, limit: int = LIMIT) -> Encoder:
    """The worker's encoder for a vocabulary file; ``pattern`` for a rank file."""
    key = (path, cut, pattern, limit)
    if key not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel
        _ENCODERS[key] = Encoder(load_ranks(path, pattern) if pattern else load_json(path), cut, limit)
    return _ENCODERS[key]
