"""Lines of page text: their consistent form, what placeholders they hold, whether they read as a sentence or as a message.

Nothing here looks at a page's address. A line is read in its consistent, case-folded form with the site's own name masked;
placeholders become one mark; hashes, lengths and endings are taken over whole Arrow columns, and Python looks only at the
lines that a linear pattern has picked out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagelore.llm import codepoints as C

#: Letters that stand for a placeholder and for the site's name; both survive wherever only letters are compared.
SLOT, BRAND = "ꙮ", "ʘ"
#: Letters of a sentence, at least (an ideogram or syllable counts three).
SENTENCE_LETTERS = 16
MIN_BRAND = 4

# --- fixed values: how template languages write a placeholder, and what programs print for a missing value ---------
PLACEHOLDERS = [
    r"\{\{\{?[^{}]*\}\}\}?", r"\{%[^%{}]*%\}", r"<%=?[^%<>]*%>", r"<<[^<>]+>>", r"\[\[[^\[\]]+\]\]",
    r"[$#]\{[^{}]*\}", r"%\([^()]+\)[a-z]", r"%%[\w.\- ]+%%", r"@@[\w.\- ]+@@", r"(?<!\w)__[a-z][\w.\-]*?__(?!\w)",
    r"\*\|[^|]+\|\*", r"(?<![\w\]])\[[a-z][\w.\-]+\](?![\w(\[])", r"<[a-z][a-z_]{2,}>", r"\[object object\]", r"\bundefined\b", r"\bnan\b",
]
# --- end of fixed values ------------------------------------------------------------------------------------------
_SLOT = re.compile("|".join(PLACEHOLDERS))
_MAYBE_SLOT = r"[{%<\[$#@]|\*\||__|undefined|nan"
_EDGE = r" \t\-–—•·*»«→>.…!|"
_EDGES = f"^[{_EDGE}]+|[{_EDGE}]+$"
_NAME = r"[^\W_][\w.\-]*"
_LABEL = re.compile(rf"^(?:/{_NAME}\s+|{_NAME}:\s+)|\s*(?:\[(?:ref )?/?{_NAME}\]|\((?:ref )?/?{_NAME}\)|\s[-–—]\s{_NAME})\s*$")
_MAYBE_LABEL = r"^/|^[^ ]+: |[\])]\s*$| [-–—] [^ ]+\s*$"
_STOP, _DOTS = r"[.。?؟।][ \t»→*]*$", r"\.\.[ \t»→*]*$"
#: A word: letters of alphabets, or of the scripts that take particles without a blank.
LETTERS = re.compile(r"[^\W\d_぀-鿿가-힣]+|[぀-鿿가-힣]+")
CRUMBS = re.compile(r"^[^.!?]{1,60}(?:\s[>›»]\s[^.!?>›»]{1,60})+$")


@lru_cache(50_000)
def brand_of(host: str | None) -> str:
    """The name a site's host carries: the label before the last one."""
    labels = re.sub(r"^[a-z][\w+.-]*://|[/:?#].*$", "", host or "", flags=re.I).casefold().split(".")
    name = labels[-2] if len(labels) > 1 else labels[0]
    return name if len(name) >= MIN_BRAND else ""


@lru_cache(50_000)
def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][\w+.-]*://|[/:?#].*$", "", url or "", flags=re.I).casefold()


def address_words(url: str | None) -> list[str]:
    """The words of an address's last segment, without suffix, query and fragment."""
    path = re.sub(r"^[a-z][\w+.-]*://[^/?#]*", "", url or "", flags=re.I)
    seg = re.sub(r"\.\w{1,5}$", "", re.split(r"[?#]", path)[0].rstrip("/").rsplit("/", 1)[-1])
    return LETTERS.findall(seg.casefold().replace("_", " "))


def hits(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(bool)


def replaced(lines: pa.Array, where: list[int], values: list[str]) -> pa.Array:
    if not where:
        return lines
    mask = np.zeros(len(lines), bool)
    mask[where] = True
    # values are taken in the order of the lines
    order = sorted(range(len(where)), key=where.__getitem__)
    return pc.replace_with_mask(lines, pa.array(mask), pa.array([values[i] for i in order], lines.type))


@dataclass
class Lines:
    """Lines of a batch of texts: row, number from 1 and which of the distinct lines. Of these: the form before folding, the form
    with the site's name and placeholders masked, and what the placeholders are."""

    row: np.ndarray
    no: np.ndarray
    which: np.ndarray
    raw: pa.Array
    text: pa.Array
    slots: dict[int, list[str]]


def read(texts: pa.Array, brands: list[str]) -> Lines:
    """Every line of a string column; nulls count as empty texts of one empty line."""
    cp, offs = C.decode(texts)
    at, row, no = C.lines(cp, offs)
    d = pc.dictionary_encode(C.encode(*C.squeeze(*C.compose(*C.reading_lut()(cp, at)))))
    names = sorted(set(brands))
    number = {b: i for i, b in enumerate(names)}
    pair = d.indices.to_numpy().astype(np.int64) * max(1, len(names)) + np.array([number[b] for b in brands], np.int64)[row]
    once, which = np.unique(pair, return_inverse=True)
    raw = d.dictionary.take(pa.array(once // max(1, len(names))))
    folded = C.encode(*C.fold_lut()(*C.decode(raw)))
    slots: dict[int, list[str]] = {}
    where, values = [], []
    maybe = set(np.flatnonzero(hits(folded, _MAYBE_SLOT)).tolist())
    for i, (t, b) in enumerate(zip(folded.to_pylist(), (once % max(1, len(names))).tolist())):
        b = names[b]
        if i in maybe and (found := _SLOT.findall(t)):
            slots[i] = found
            where.append(i)
            values.append(_SLOT.sub(f" {SLOT} ", t).replace(b, BRAND) if b else _SLOT.sub(f" {SLOT} ", t))
        elif b and b in t:
            where.append(i)
            values.append(t.replace(b, BRAND))
    return Lines(row, no, which, raw, replaced(folded, where, values), slots)


def unlabelled(lines: pa.Array) -> tuple[pa.Array, list[int]]:
    """Lines without a label (one name before a colon or after a dash, or in brackets or after a slash at either end), and which
    had one."""
    where, values = [], []
    for i in np.flatnonzero(hits(lines, _MAYBE_LABEL)).tolist():
        t = lines[i].as_py()
        if (v := _LABEL.sub("", t)) != t:
            where.append(i)
            values.append(v)
    return replaced(lines, where, values), where


def bare(lines: pa.Array) -> pa.Array:
    """Lines without bullets, arrows and stops at their ends."""
    return pc.replace_substring_regex(lines, _EDGES, "")


def letters(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the hash of its letters (of the line itself if it has none) and how many it has, an ideogram or syllable for three."""
    cp, offs = C.decode(lines)
    lcp, loffs = C.letters_lut()(cp, offs)
    far = np.flatnonzero(lcp >= 0x3040)
    wide = far[(lcp[far] < 0xA000) | ((lcp[far] >= 0xAC00) & (lcp[far] < 0xD7A4))]
    n = np.diff(loffs)
    h = C.row_hash(lcp, loffs)
    none = n == 0
    if none.any():
        h = np.where(none, C.row_hash(cp, offs, 5), h)
    return h, n + 2 * np.diff(np.searchsorted(wide, loffs))


def stops(lines: pa.Array) -> np.ndarray:
    return hits(lines, _STOP) & ~hits(lines, _DOTS)


def filled(lines: pa.Array) -> np.ndarray:
    return pc.binary_length(lines).to_numpy(zero_copy_only=False) > 0


def words(lines: pa.Array, numbers: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all lines one after the other, and the offsets of the lines. A word is letters of alphabets, or of the
    scripts that take particles without a blank; with `numbers`, every number is one word."""
    lines = pc.replace_substring_regex(lines, f"[぀-鿿가-힣]+|{BRAND}", r" \0 ")
    if numbers:
        lines = pc.replace_substring_regex(lines, r"\p{N}+", "9")
    lines = pc.utf8_trim(pc.replace_substring_regex(lines, r"[^\p{L}9]+" if numbers else r"[^\p{L}]+", " "), characters=" ")
    lists = pc.split_pattern(lines, " ")
    size = np.where(filled(lines), pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0)
    flat = lists.flatten()
    flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    d = pc.dictionary_encode(flat)
    h = word_hash(d.dictionary)
    return h[d.indices.to_numpy()] if len(flat) else np.empty(0, np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def word_hash(ws: list[str] | pa.Array) -> np.ndarray:
    return C.row_hash(*C.decode(ws if isinstance(ws, pa.Array) else pa.array(ws, pa.string())))
