"""The tokenizer for table-valued SQL calls, where expressions cannot go."""

from __future__ import annotations

import regex

_WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
_TOKEN = regex.compile(rf"[{_WS}]+|[\p{{L}}\p{{M}}\p{{N}}]+(?:(?<=[\p{{L}}\p{{M}}])[-‐‑](?=[\p{{L}}\p{{M}}])[\p{{L}}\p{{M}}\p{{N}}]+)*|(?s:.)")


def token_rows(text: str):
    """``(tok_idx, text, start, end)`` of a text."""
    for i, m in enumerate(_TOKEN.finditer(text)):
        yield i, m.group(), m.start(), m.end()
