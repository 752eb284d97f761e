"""Token ids of texts with a byte-level BPE file, as the tokenizers library gives them."""

from __future__ import annotations

import base64
import json
import os
import re
from array import array

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
# The letters, numbers and white space among the first 256 characters, and the vocabulary's pattern in these terms.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_1 = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
CACHED = 1_000_000  # pre-tokens whose ids a worker remembers
CACHED_CHARS = 48  # longer ones are encoded each time
_LOADED: dict[str, "Encoder"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Ids of pre-tokens as bytes, encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        found = array("I", self.encode(piece.encode())).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Ids of whole texts, without added special tokens; special strings in a text are special tokens.

    Texts of Latin-1 characters without special strings are split here and each new pre-token is encoded by tiktoken
    over the same vocabulary, which gives the same ids several times faster. All others go to the tokenizers library
    itself: the two libraries' Unicode tables could differ there.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.path = path
        self.special = [t["content"] for t in content.get("added_tokens", [])]
        ranks_path = os.path.splitext(path)[0] + ".tiktoken"
        with open(ranks_path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = public_tokenizers.PATTERN
        self.fast = tiktoken.Encoding("bpe", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.split_latin = re.compile(LATIN_1).findall
        self.pieces = _Pieces(self.fast._encode_single_piece)
        self._exact = None

    @property
    def exact(self):
        if self._exact is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._exact = Tokenizer.from_file(self.path)
            self._exact.no_truncation()
            self._exact.no_padding()
        return self._exact

    def plain(self, text: str) -> bool:
        """Whether the text can go to the faster library."""
        if any(s in text for s in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def id_bytes(self, text: str) -> bytes:
        """The ids as unsigned 32-bit numbers, little-endian."""
        if self.plain(text):
            return b"".join(map(self.pieces.__getitem__, self.split_latin(text)))
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.id_bytes(text), dtype="<u4")


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in a process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
