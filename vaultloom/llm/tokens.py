"""Token ids from a public tokenizer file."""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: the split pattern of a byte-level tokenizer that uses its own regex.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TextTokenizer:
    """encode(texts) gives the ids that `tokenizers` gives for the file, without special tokens; strings of special tokens are ordinary text.

    Where a byte-level file's merges are in the order of their ids, as ranks are, its vocabulary is handed to `tiktoken`,
    which gives the same ids in about a third of the time (tests/llm compares them). Any other file is run by `tokenizers` itself,
    as is any text that the pattern engine of `tiktoken` gives up on: it backtracks over a run of a million blanks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path) as f:
            ranks = self._ranks(json.load(f))
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _ranks(kind: dict) -> dict[bytes, int] | None:
        pre, model = kind.get("pre_tokenizer") or {}, kind["model"]
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or kind.get("normalizer") or model["type"] != "BPE":
            return None
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get("".join(m)) for m in merges]
        if None in ids or ids != sorted(set(ids)):
            return None
        letters = _byte_letters()
        special = {t["content"] for t in kind.get("added_tokens", []) if t.get("special")}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special and all(c in letters for c in token)}
        return ranks if len(ranks) == 256 + len(merges) else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        except ValueError:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
