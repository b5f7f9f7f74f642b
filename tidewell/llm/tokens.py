"""Byte-level BPE ids of whole texts, the same as the ``tokenizers`` library gives for the JSON file.

The file's merge table, run by ``tiktoken`` when the vocabulary also lies beside it as ranks, gives
equal ids several times faster; texts with very long runs without a space go to ``tokenizers``
itself, whose merging stays near linear there. Tests hold the two against each other.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np

END = "<|endoftext|>"
_LONG_RUN = re.compile(r"\S{2000}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_of(path: str) -> dict[str, int]:
    """Ids of all tokens of the file, read without building the library's tokenizer, which takes much longer."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return found["model"]["vocab"] | {t["content"]: t["id"] for t in found.get("added_tokens", [])}


def encoder(path: str, arrays: bool = False, vocabulary: dict[str, int] | None = None):
    """A function from a text to its list (or array) of ids, without added special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = functools.cache(lambda: Tokenizer.from_file(path))  # only texts with long runs need it, where ranks are there
    listed = lambda text: slow().encode(text, add_special_tokens=False).ids
    plain = (lambda text: np.array(listed(text), np.uint32)) if arrays else listed
    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks_path):
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: (vocabulary or vocabulary_of(path))[END]})

    run = fast.encode_to_numpy if arrays else fast.encode

    def encode(text: str):
        if _LONG_RUN.search(text):
            return plain(text)
        return run(text, allowed_special="all")

    return encode
