r"""Texts to the ids of a byte-level BPE file of the ``tokenizers`` library.

The file's vocabulary is handed to the faster ``tiktoken`` library as ranks, which gives
the same ids where merges stand in the order of their ids (checked while loading).
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken

from quarrylens.llm.bpe import byte_letters

#: Fixed value: the splitting rule of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteCodes:
    """``ids(text)`` as unsigned 32-bit integers; special tokens in a text become their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte_of = {x: b for b, x in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError(f"the merges of {path} aren't in the order of their ids")
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> np.ndarray:
        return self.encoding.encode_to_numpy(text or "", allowed_special="all")


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteCodes:
    """The encoder of a file, once in each Python worker."""
    return ByteCodes(path)
