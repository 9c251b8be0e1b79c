"""Token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import json

import numpy as np

from .bytewords import text_bytes

#: First byte of UTF-8 from which a character may be classed differently by two regex engines.
#: Below are ASCII, Latin-1 and Latin Extended, whose classes are the same in both.
_RARE_FROM = 0xC9

_ENCODERS: dict = {}


class BpeEncoder:
    """The ids that `tokenizers` gives with add_special_tokens=False.

    Texts of common characters, without the text of a special token, go through a faster engine
    that has the same vocabulary and splits them in the same way; others through `tokenizers`.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        import public_tokenizers

        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts):
        """An array of ids for each text of an Arrow array; of a null, an empty one."""
        data, cuts = text_bytes(texts)
        rare = np.zeros(len(cuts) - 1, dtype=bool)
        rare[np.searchsorted(cuts, np.flatnonzero(data >= _RARE_FROM), side="right") - 1] = True
        for text, odd in zip(texts.to_pylist(), rare.tolist(), strict=True):
            if not text:
                yield np.zeros(0, dtype=np.uint32)
            elif odd or any(s in text for s in self.special):
                yield np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                yield self.fast.encode_to_numpy(text, disallowed_special=())


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, the others in order for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> BpeEncoder:
    """One encoder for each file and process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BpeEncoder(path)
    return _ENCODERS[path]
