"""Token ids of whole texts by a byte-level BPE, one pre-token at a time.

The merges never cross a pre-token, so each different pre-token is encoded once
per Python worker and its ids are looked up afterwards. Texts that hold one of the
vocabulary's special tokens go through the library's own encoder.
"""

from __future__ import annotations

import array
import json
import re

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from morphspark.llm import common

TOKENIZER = "byte_bpe_50k.json"
END = 1
#: The pre-token pattern of the vocabulary for Python's re: [^\\W\\d_] for letters is exact only
#: where UNSURE finds nothing (other numbers than decimal digits, marks that \\w holds).
FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Latin, Greek and Cyrillic letters, ASCII and general punctuation: there FAST equals the pattern.
SURE = re.compile(r"[\x09-\x0D\x20-\x7EÀ-ɏͰ-ͳΆ-҂Ҋ-ԯ‐-‧‰-⁞]*")
#: Entries of a generation of a memory of pre-tokens or parts.
MEMORY = 300_000


class Memory(dict):
    """Values made where they are missing. Beyond MEMORY entries a new generation begins, and what is asked again moves to it from the last."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def vocabulary(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.splits = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})")
        self.ordinary = None
        self.single = self._single(path)
        self.known, self.parts = Memory(self._ids), Memory(self._part)

    def _single(self, path: str):
        """The ids of one pre-token. Where ids follow the order of the merges, tiktoken's merger gives the same ones sooner."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shift = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in shift]
        byte = {chr(b): b for b in shift} | {chr(256 + i): b for i, b in enumerate(rest)}
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        if model["type"] != "BPE" or any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)) or sorted(ranks.values()) != list(range(256 + len(merges))):
            return lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        merger = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.ordinary = merger.encode_ordinary
        return lambda x: merger.encode_single_piece(x.encode("utf-8"))

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text, a special token being one of its own; joined they are the text."""
        if any(x in text for x in self.special):
            return [y for x in self.splits.split(text) if x for y in ([x] if x in self.special else self._split(x))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        return (FAST if SURE.fullmatch(text) else self.pattern).findall(text)

    def _ids(self, piece: str) -> bytes:
        """The ids of a pre-token."""
        return array.array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids if piece in self.special else self.single(piece)).tobytes()

    def _part(self, part: str) -> bytes | None:
        """The ids of a part and the space before it; None where white space beside that space would change them."""
        if not part or part[0].isspace() or part[-1].isspace():
            return None
        if self.ordinary and SURE.fullmatch(part):  # few of them come again: their pre-tokens aren't kept
            return array.array("I", self.ordinary(" " + part)).tobytes()
        return self._of_pieces(" " + part)

    def _of_pieces(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> bytes:
        """All ids of a text.

        A space begins a pre-token unless white space stands beside it; so a text in which none
        does splits at its spaces, and parts are looked up whole.
        """
        if any(x in text for x in self.special):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        head, *parts = text.split(" ")
        if parts and (not head or head[-1].isspace()):
            return self._of_pieces(text)
        try:
            return self._of_pieces(head) + b"".join(map(self.parts.__getitem__, parts))
        except TypeError:  # a part without ids of its own
            return self._of_pieces(text)

    def lengths(self, pieces: list[str]) -> list[int]:
        """Number of ids of each pre-token."""
        return [len(x) >> 2 for x in map(self.known.__getitem__, pieces)]


_ENCODERS: dict[str, Encoder] = {}
common.KEPT.append(_ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """The encoder of this process; what it has learnt serves later tasks of the same Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
