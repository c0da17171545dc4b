"""Token counts of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import tiktoken

#: Folder of the vocabulary files; a parameter, as they are no part of this repository.
DEFAULT_FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
#: How the vocabulary cuts a text before merging (fixed value of its publishers).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a ``.tiktoken`` file, loaded once a process; strings of special tokens are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(folder: str | None = None, file: str = DEFAULT_FILE) -> str:
    return os.path.join(folder or DEFAULT_FOLDER, file)
