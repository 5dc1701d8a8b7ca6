"""Places of public tokenizer files. The path is a parameter of every operator; this is its default."""
from __future__ import annotations


def path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
