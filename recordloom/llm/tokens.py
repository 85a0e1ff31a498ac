"""Token ids of texts, by the tokenizers library, with a cache of pieces.

The vocabulary lower-cases, drops white space and splits text into pieces that
are merged one by one. Text of ASCII and Latin letters has nothing else to
normalize: it is split by the vocabulary's own pattern, and every distinct piece
is merged by the library once per cache life. Where other characters occur, the
parts between ASCII white space, which nothing reaches across, are encoded by
the library whole.
"""

from __future__ import annotations

import functools
import re

import numpy as np

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
# Pieces longer than this are not kept. Those not asked for lately go when there
# are too many: memory is bounded.
LONGEST_KEPT = 48
CACHE_SIZE = 400_000
# Fixed value: the vocabulary's split pattern, for lower-cased plain text.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from 256 on."""
    others = [b for b in range(256) if b not in PRINTABLE]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(others)}


LETTER = byte_letters()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Recent(dict):
    """What ``make`` gives for a key, kept for keys asked for lately."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= CACHE_SIZE // 2:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, each followed by the end id."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.pieces, self.parts = Recent(self._piece), Recent(self._part)
        self.end = as_bytes([end_id])

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(map(LETTER.__getitem__, piece.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(letters)])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text.lower())))

    def _part(self, part: str) -> bytes:
        if "<|" not in part and PLAIN.fullmatch(part):
            return self._plain(part)
        return as_bytes(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if "<|" not in text and PLAIN.fullmatch(text):  # the names of special tokens are no pieces
            return self._plain(text) + self.end
        return b"".join([self.parts[p.decode()] for p in text.encode().split()]) + self.end


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path, end_id)
