"""Encoding whole texts with a public byte-level BPE vocabulary inside tasks."""

from __future__ import annotations

import base64
import re
from functools import cached_property
from pathlib import Path

import numpy as np

from notemill.llm.workers import kept

END_OF_TEXT = "<|endoftext|>"
#: Distinct space-free chunks whose ids a worker keeps.
CACHE_CHUNKS = 120_000
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_SPACE_RUN = re.compile(r"\s ")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class _Chunks(dict):
    """Ids, as little-endian 32-bit bytes, of `` `` + chunk."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(" " + chunk)
        if len(self) < CACHE_CHUNKS and len(chunk) < 64:
            self[chunk] = ids
        return ids


class ByteBpe:
    """``encode(text)`` gives the ids of ``tokenizers`` (no special tokens added) as little-endian uint32 bytes.

    No token of this vocabulary's splitting rule reaches from a non-space
    character over the space after it, so a text is cut there and the ids of
    each chunk are looked up. A text that spells the end-of-text token is given
    to ``tokenizers`` whole, which maps it to that token's id.
    """

    def __init__(self, path: str):
        self.path = path
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.plain = lambda text: np.array(fast.encode_ordinary(text), "<u4").tobytes()
            self.decode = lambda ids: fast.decode(ids.tolist())
        else:
            self.plain = self._whole
            self.decode = lambda ids: self.whole.decode(ids.tolist(), skip_special_tokens=False)
        self.chunks = _Chunks(self.plain)

    @cached_property
    def whole(self):
        """Read on first use: few texts need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if END_OF_TEXT in text:
            return self._whole(text)
        if _SPACE_RUN.search(text):
            first, *rest = _BEFORE_SPACE.split(text)
            rest = [x[1:] for x in rest]
        else:
            first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.chunks.__getitem__, rest))

    def encode_ordinary(self, text: str) -> bytes:
        """As ``encode``, but the end-of-text token's spelling is ordinary text."""
        if END_OF_TEXT not in text:
            return self.encode(text)
        return b"".join(self.encode(x) for x in re.split(r"(?<=<)(?=\|endoftext)", text))


def byte_bpe(path: str) -> ByteBpe:
    return kept(("byte_bpe", path), lambda: ByteBpe(path))
