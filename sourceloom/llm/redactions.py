"""Edits that mask personal data and shorten runs of one sign, found in time that grows with the text alone.

Mail addresses, keys of 32 or more hexadecimal digits and long numbers become a mark of their kind; two or more equal signs become one.
The leftmost edit comes first, and of several that begin at one place the first of the kinds named above; they don't overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from sourceloom.llm.token_counts import Edit

_DOMAIN = re.compile(r"[\w-]+\.[\w.]+")
_KEY = re.compile(r"\b[0-9a-f]{32,}\b")
_NUMBER = re.compile(r"\+?\d[\d .()-]{6,}\d")
_SIGNS = re.compile(r"([^\w\s])\1+")
_HEX, _NUMERIC, _SIGN = (np.zeros(256, bool) for _ in range(3))
_HEX[list(b"0123456789abcdef")] = True
_NUMERIC[list(b"0123456789 .()-")] = _NUMERIC[128:] = True
_SIGN[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~")] = True


def _long_run(marks: np.ndarray, least: int) -> bool:
    """Whether ``least`` marks stand in a row."""
    edges = np.flatnonzero(~marks)
    return len(marks) >= least and (not len(edges) or max(edges[0], len(marks) - 1 - edges[-1], (np.diff(edges).max() - 1 if len(edges) > 1 else 0)) >= least)


def _doubled(data: np.ndarray) -> bool:
    """Whether a sign, or any character beyond ASCII, may stand twice in a row."""
    if (_SIGN[data[:-1]] & (data[:-1] == data[1:])).any():
        return True
    if not (data >= 128).any():
        return False
    return any((data[:-k] == data[k:])[data[:-k] >= 0xC0].any() for k in (2, 3, 4) if len(data) > k)


def _mails(text: str) -> Callable[[int], tuple[int, int] | None]:
    def after(position: int) -> tuple[int, int] | None:
        at = text.find("@", position)
        while at >= 0:
            start = at
            while start > position and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
                start -= 1
            found = _DOMAIN.match(text, at + 1) if start < at else None
            if found:
                return start, found.end()
            position, at = at + 1, text.find("@", at + 1)
        return None
    return after


def _matches(pattern: re.Pattern, text: str) -> Callable[[int], tuple[int, int] | None]:
    def after(position: int) -> tuple[int, int] | None:
        found = pattern.search(text, position)
        return found.span() if found else None
    return after


def redactions(text: str) -> list[Edit]:
    """The edits of a text, ascending and apart."""
    data = np.frombuffer(text.encode(), np.uint8)
    kinds: list[tuple[str | None, Callable]] = []
    if "@" in text:
        kinds.append(("<mail>", _mails(text)))
    if _long_run(_HEX[data], 32):
        kinds.append(("<key>", _matches(_KEY, text)))
    if _long_run(_NUMERIC[data], 8):
        kinds.append(("<number>", _matches(_NUMBER, text)))
    if _doubled(data):
        kinds.append((None, _matches(_SIGNS, text)))
    ahead, out, end = [after(0) for _, after in kinds], [], 0
    while True:
        for k, (_, after) in enumerate(kinds):
            if ahead[k] and ahead[k][0] < end:
                ahead[k] = after(end)
        best = min((k for k in range(len(kinds)) if ahead[k]), key=lambda k: (ahead[k][0], k), default=None)
        if best is None:
            return out
        start, end = ahead[best]
        out.append((start, end, kinds[best][0] or text[start]))
