"""Exact ids of the word-level BPE through the tokenizers library, one call per distinct word of a task."""

from __future__ import annotations

import os
import re
import struct

from larder.llm.common import memo

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Distinct pieces that a worker remembers; a speed setting, results do not depend on it.
REMEMBERED = 250_000

_WORD = re.compile(r"([a-zß-öø-ÿ]+)([.,!#*$%&|:;?]*)").fullmatch


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Texts to little-endian 32-bit ids.

    The normaliser collapses white space and the splitter drops it, so pieces between spaces are independent.
    A piece of plain letters (Latin-1, which every normal form leaves alone) with trailing marks goes to the
    library's model directly; any other piece goes through the whole library pipeline.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def _part(self, word: str) -> bytes:
        found = self.parts.get(word)
        if found is None:
            shown = word.encode().decode("latin-1").translate(self.letters)
            found = self.parts[word] = packed([t.id for t in self.model.tokenize(shown)])
        return found

    def _learn(self, pieces: set[str]) -> None:
        if len(self.pieces) + len(pieces) > REMEMBERED:
            self.pieces = {}
        if len(self.parts) > REMEMBERED:
            self.parts = {"": b""}
        other = []
        for piece in pieces - self.pieces.keys():
            match = _WORD(piece.lower()) if piece.isascii() or max(piece) <= "ÿ" else None
            if match:
                self.pieces[piece] = self._part(match[1]) + self._part(match[2])
            else:
                other.append(piece)
        for piece, got in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False)):
            self.pieces[piece] = packed(got.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        out, block, size = [], [], 0
        for text in texts:
            block.append(text.replace("\n", " ").split(" "))
            size += len(text)
            if size > 8_000_000:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, block):
        self._learn(set().union(*block))
        get = self.pieces.__getitem__
        return [b"".join(map(get, pieces)) for pieces in block]


def encoder(path: str) -> WordEncoder:
    """The encoder of this process; workers are reused between tasks."""
    return memo(f"encoder {path}", lambda: WordEncoder(path))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
