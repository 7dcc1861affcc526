"""Token ids of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: the pattern by which this vocabulary splits texts before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The id that ends every document.
END_ID = 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    own = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    rest = [c for c in range(256) if c not in set(own)]
    return {chr(c): c for c in own} | {chr(256 + k): c for k, c in enumerate(rest)}


class Encoder:
    """ids of texts as the vocabulary's own library gives them: merges by rank, its added tokens found in texts."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.exact = path, None
        self.added = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in self.added}
        self.merges = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if any(a in text for a in self.added):
            return np.array(self.slow().encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.merges.encode_ordinary(text), "<u4")

    def slow(self):
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
        return self.exact

    def document(self, text: str | None) -> np.ndarray:
        """The text's ids, then END_ID; a null text is an empty one."""
        return np.append(self.ids(text), np.array([END_ID], "<u4"))
