"""Splitting texts into pre-tokens."""

from __future__ import annotations

import re

import public_tokenizers
import regex

_FULL = regex.compile(public_tokenizers.PATTERN)
#: Characters on which the standard ``re`` classes agree with \p{L}, \p{N} and \s: no odd numerals,
#: marks, separators or unassigned points. On them ``re`` splits alike, in less than half the time.
_PLAIN = re.compile("[\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ʯ‐-‧€]*")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def split(text: str) -> list[str]:
    """All matches of the public pattern, in order."""
    return _FAST.findall(text) if _PLAIN.fullmatch(text) else _FULL.findall(text)
