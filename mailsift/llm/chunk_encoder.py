"""Token ids and offsets of whole texts, encoding each distinct chunk of a worker once.

A text is cut where its tokenizer never joins characters: at ASCII white space, where white space is
dropped, or before a space that a further word follows, where a space belongs to the word after it. The
ids of the text are those of its chunks one after the other, so frequent words are looked up, and a
text is encoded exactly once and whole. The table of chunks is bounded and emptied when it is full.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

# Chunks that a worker keeps from task to task, some 200 MB; who has less memory passes a smaller number.
CHUNKS_KEPT = 1_000_000

_SPACE = re.compile("[\x20\x09-\x0d]+")
# White space that str.split() sees beside the ASCII white space above.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
# A space that a character other than white space follows begins a chunk of the byte kind.
_BEFORE_WORD = regex.compile(r"(?= \S)")
_RUN_OF_SPACE = regex.compile(r"\s[^\S\n]|\s\n|[^\S ] ")
_LATIN = re.compile("[\x21-\x7e\xa1-\xff]+")


def _lowered(text: str) -> str:
    """Lower case where that is a matter of single characters (Latin-1), so more chunks are equal."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class WordPieces:
    """Ids of chunks by a tokenizers file of the word kind.

    Chunks of Latin-1 characters, of which normalisation changes the case only, are split by the file's own
    pattern and handed to its model; any other chunk takes the whole of the file's pipeline.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = True
        self._model = self._whole.model
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)["pre_tokenizer"]["pretokenizers"]
        self._split = regex.compile(steps[0]["pattern"]["Regex"])
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        hidden = [b for b in range(256) if b not in shown]
        self._shown = {b: 256 + i for i, b in enumerate(hidden)}
        self._known: dict[str, list[int]] = {}

    def _of_chunk(self, chunk: str) -> list:
        """Tokens of a chunk that is not a word of ASCII letters."""
        if not _LATIN.fullmatch(chunk):
            return self._whole.encode(chunk, add_special_tokens=False).ids
        tokenize, ids = self._model.tokenize, []
        for piece in self._split.findall(chunk.lower()):
            known = self._known.get(piece)
            if known is None:
                shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._shown)
                known = [token.id for token in tokenize(shown)]
                if len(piece) < 4:
                    self._known[piece] = known
            ids += known
        return ids

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, None]:
        """Ids of all chunks end to end, and the number of ids of each chunk."""
        tokenize = self._model.tokenize
        found = [
            [t.id for t in tokenize(c.lower())] if c.isascii() and c.isalpha() else self._of_chunk(c) for c in chunks
        ]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        return ids, counts, None


class BytePieces:
    """Ids and character spans of chunks by a rank file of the byte kind."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._coding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self._bytes[rank] = len(token)

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks end to end, the number of ids of each chunk, and spans within the chunk."""
        encode = self._coding.encode_ordinary
        found = [encode(c) for c in chunks]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        end = np.cumsum(self._bytes[ids])
        # Characters of the chunks laid end to end, by byte.
        char = np.cumsum((np.frombuffer("".join(chunks).encode(), np.uint8) & 0xC0) != 0x80) - 1
        wide = np.fromiter(map(len, chunks), np.int64, len(chunks))
        spans = np.stack([char[end - self._bytes[ids]], char[end - 1] + 1], axis=1)
        return ids.astype(np.uint32), counts, spans - np.repeat(np.cumsum(wide) - wide, counts)[:, None]


class _Numbers(dict):
    """Numbers of chunks; a new chunk gets the next one and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class ChunkEncoder:
    """``kind`` is "word" (white space is dropped) or "byte" (a space belongs to the word after it)."""

    def __init__(self, path: str, kind: str, pattern: str = "", kept: int = CHUNKS_KEPT):
        self._kind, self._kept = kind, kept
        self._pieces = WordPieces(path) if kind == "word" else BytePieces(path, pattern)
        self.forget()

    def forget(self) -> None:
        """Give the table of chunks up; what is encoded does not depend on it."""
        self._number = _Numbers()
        self._count = np.zeros(1 << 16, np.int64)
        self._first = np.zeros(1 << 16, np.int64)
        self._ids = np.zeros(1 << 18, np.uint32)
        self._spans = np.zeros((1 << 18, 2), np.int32) if self._kind == "byte" else None
        self._used = 0

    def _learn(self) -> None:
        """Encode the chunks that were numbered since the last call."""
        chunks, self._number.new = self._number.new, []
        while len(self._number) > len(self._count):
            self._count = np.concatenate([self._count, np.zeros_like(self._count)])
            self._first = np.concatenate([self._first, np.zeros_like(self._first)])
        ids, counts, spans = self._pieces(chunks)
        upto = self._used + len(ids)
        while upto > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
            if spans is not None:
                self._spans = np.concatenate([self._spans, np.zeros_like(self._spans)])
        self._ids[self._used : upto] = ids
        if spans is not None:
            self._spans[self._used : upto] = spans
        first = len(self._number) - len(chunks)
        self._count[first : first + len(chunks)] = counts
        self._first[first : first + len(chunks)] = self._used + np.cumsum(counts) - counts
        self._used = upto

    def _chunks(self, text: str) -> list[str]:
        if self._kind == "word":
            return [c for c in _SPACE.split(text) if c] if _OTHER_SPACE.search(text) else _lowered(text).split()
        if _RUN_OF_SPACE.search(text):
            return [c for c in _BEFORE_WORD.split(text) if c]
        chunks = text.split(" ")
        if not chunks[-1]:
            chunks = [*chunks[:-2], chunks[-2] + " "] if len(chunks) > 1 else []
        return [c for c in [*chunks[:1], *[" " + c for c in chunks[1:]]] if c]

    def encode(self, texts: list[str]):
        """Ids of all texts end to end, the number of ids of each text, and for the byte kind the spans.

        Spans are the characters of the text that a token covers: its first, and the one after its last.
        """
        split = [self._chunks(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        if len(self._number) + int(sizes.sum()) // 4 > self._kept:
            self.forget()
        number = np.fromiter(
            map(self._number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if self._number.new:
            self._learn()
        counts = self._count[number]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(self._first[number] - (ends - counts), counts)
        ids = self._ids[where]
        at = np.concatenate([[0], np.cumsum(sizes)])
        upto = np.concatenate([[0], ends])
        lengths = upto[at[1:]] - upto[at[:-1]]
        if self._spans is None:
            return ids, lengths
        wide = np.fromiter(map(len, chain.from_iterable(split)), np.int64, len(number))
        before = np.cumsum(wide) - wide
        held = sizes > 0
        starts = before - np.repeat(before[at[:-1][held]], sizes[held])
        return ids, lengths, self._spans[where].astype(np.int64) + np.repeat(starts, counts)[:, None]


@lru_cache(maxsize=4)
def _loaded(path: str, kind: str, pattern: str, kept: int) -> ChunkEncoder:
    return ChunkEncoder(path, kind, pattern, kept)


@contextmanager
def worker_encoder(path: str, kind: str, pattern: str = "", kept: int | None = None) -> Iterator[ChunkEncoder]:
    """The encoder of this Python worker, whose files are read once.

    Its table of chunks lasts from task to task; if ``kept`` bounds it, it also goes when a task ends.
    """
    encoder = _loaded(path, kind, pattern, kept or CHUNKS_KEPT)
    try:
        yield encoder
    finally:
        if kept:
            encoder.forget()
