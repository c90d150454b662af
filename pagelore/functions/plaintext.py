"""The token functions on plain Python strings, for operators that have to run in Python."""

from __future__ import annotations

import re

from pagelore.functions import lexicon as L

_COMMA = re.compile(r"(?<=[0-9]),(?=[0-9])")
_OTHER = re.compile(f"[^0-9a-z{L.CJK}]+")
_BORDER = re.compile(f"(?<=[0-9a-z])(?=[{L.CJK}])|(?<=[{L.CJK}])(?=[0-9a-z])")
_CJK = re.compile(f"[{L.CJK}]")


def normalize(text: str) -> str:
    return _BORDER.sub(" ", _OTHER.sub(" ", _COMMA.sub("", text).lower())).strip()


def stem(t: str) -> str:
    if t.isascii():
        for s in L.STEM_SUFFIXES:
            if t.endswith(s) and len(t) > len(s) + 2:
                return t[: -len(s)]
    return t


def expand(t: str) -> list[str]:
    if not _CJK.search(t):
        return [stem(t)]
    return sorted({stem(t), *(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))})


def all_tokens(text: str) -> list[str]:
    return [x for t in normalize(text).split() for x in expand(t)]


def is_significant(t: str) -> bool:
    return (t.isascii() and t.isdigit()) or (len(t) >= 2 if _CJK.search(t) else len(t) >= 3 and t not in L.STOP_WORDS)


def significant(text: str) -> list[str]:
    return sorted({t for t in all_tokens(text) if is_significant(t)})


def anchors(tokens: list[str]) -> list[str]:
    return sorted({t for t in tokens if len(t.encode()) >= 5 and t not in L.ANCHOR_STOP_WORDS and t not in L.QUALIFIERS})


def tokens_match(a: str, b: str) -> bool:
    if not (a.isascii() and b.isascii()):
        return a in b or b in a
    return a == b or (len(a) >= 4 and b.startswith(a)) or (len(b) >= 4 and a.startswith(b))
