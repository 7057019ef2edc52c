"""Public tokenizers by name: where their files lie is a parameter, nothing is trained or copied."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from pathlib import Path

#: Pretoken pattern of the byte-level vocabularies (fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pretoken pattern of the lower-casing word vocabulary (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Characters for which Python's own classes agree with the tokenizers' Unicode properties.
_PLAIN = re.compile(r"[^\x00-\x1B\x20-\x7FÀ-ÖØ-öø-ʯ가-힣ぁ-ゖァ-ヺー一-鿋、。「」・–—•…]")
_BYTE_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def is_plain(text: str) -> bool:
    return not _PLAIN.search(text)


@functools.cache
def full_pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def byte_pretokens(text: str) -> list[str]:
    """The stretches of a text within which the byte-level vocabularies merge."""
    return (_BYTE_PLAIN if is_plain(text) else full_pattern(BYTE_PATTERN)).findall(text)


def folder(path: str | None = None) -> str:
    """The vocabulary folder: the argument, else FOLIANT_TOKENIZERS, else /opt/tokenizers."""
    return path or os.environ.get("FOLIANT_TOKENIZERS", "/opt/tokenizers")


@functools.cache
def byte_encoding(name: str, path: str):
    """A byte-level encoder from the rank file ``name``.tiktoken, without special tokens."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(Path(path) / f"{name}.tiktoken", "rb"))}
    return tiktoken.Encoding(name, pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def json_tokenizer(name: str, path: str):
    """The tokenizer in ``name``.json, reading special tokens' strings as ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(Path(path) / f"{name}.json"))
    t.encode_special_tokens = True
    return t


@functools.cache
def merges(name: str, path: str) -> list[tuple[str, str]]:
    """The ordered merge list of ``name``.json; one character stands for one byte."""
    found = json.loads((Path(path) / f"{name}.json").read_text(encoding="utf-8"))["model"]["merges"]
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in found]
