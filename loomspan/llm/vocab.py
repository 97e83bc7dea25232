"""Vocabulary files of public tokenizers, read where they lie (never copied)."""

from __future__ import annotations

import base64
import os

#: Folder of the vocabulary files; every operator that needs one takes the path as a parameter.
TOKENIZER_DIR = os.environ.get("LOOMSPAN_TOKENIZERS", "/opt/tokenizers")
BYTE_VOCABULARY = os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte pieces and their ids from a file of ``base64 id`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
