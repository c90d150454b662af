"""Unicode work on whole Arrow columns: code-point arrays, lookup-table gathers, vectorised mark composition.

A column is one array of code points plus row offsets. Every step is a numpy operation over the whole batch; strings are
decoded and encoded once per batch, never per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# --- fixed values: characters drawn like an ASCII letter or hyphen, by script -------------------------------------
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ѵ": "v", "ү": "y", "ґ": "r", "А": "A", "В": "B", "Е": "E", "К": "K",
    "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ӏ": "I", "Ѵ": "V", "Ү": "Y", "Ԍ": "G", "Ԁ": "d",
    # Greek
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "ո": "n", "օ": "o", "հ": "h", "յ": "j", "ս": "u", "ց": "g", "զ": "q", "ք": "p", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    # Latin letters outside ASCII without a decomposition
    "ɡ": "g", "ɑ": "a", "ı": "i", "ɩ": "i", "ȷ": "j", "ʏ": "Y", "ɪ": "I", "ꓲ": "I", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v",
    "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ᴜ": "u",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # hyphens
    "‐": "-", "‑": "-", "˗": "-", "⁃": "-", "−": "-", "﹣": "-", "－": "-",
}
#: Characters of no width that are not in the format category.
ALSO_INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2065, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Format characters that are drawn.
DRAWN_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Compatibility forms that make a different reading.
OWN_READING = {"<super>", "<sub>", "<circle>", "<fraction>"}
# --- end of fixed values ------------------------------------------------------------------------------------------

SPACE = 0x20
#: Bytes of text whose code points are worked on at once.
PIECE_BYTES = 1 << 20
N_CODES = 0x110000
#: Planes that hold anything with a decomposition, a case pair or a special category; other code points stand for themselves.
_RANGES = (range(0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200))


class Lut:
    """A map from code point to a sequence of code points, kept as one pool with starts and lengths."""

    def __init__(self, f):
        self.start = np.arange(N_CODES, dtype=np.int32)
        self.length = np.ones(N_CODES, dtype=np.uint8)
        pool, at = [], N_CODES
        for r in _RANGES:
            for c in r:
                seq = f(c)
                if seq is not None:
                    self.start[c], self.length[c] = at, len(seq)
                    pool.extend(seq)
                    at += len(seq)
        self.pool = np.concatenate([np.arange(N_CODES, dtype=np.uint32), np.array(pool, dtype=np.uint32)])
        self.first = np.where(self.length == 1, self.pool[np.minimum(self.start, len(self.pool) - 1)], np.arange(N_CODES, dtype=np.uint32)).astype(np.uint32)

    def __call__(self, cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gather: each code point is replaced by its sequence; `offs` moves by the expansion offsets."""
        n = self.length[cp]
        odd = np.flatnonzero(n != 1)
        if not len(odd):
            return self.first[cp], offs
        k = n[odd].astype(np.int64)
        moved = np.concatenate([[0], np.cumsum(k - 1)])
        out = np.repeat(self.first[cp], n)
        many = k > 1
        to, start, size = (odd + moved[:-1])[many], self.start[cp[odd[many]]].astype(np.int64), k[many]
        for i in range(int(size.max(initial=0))):
            w = size > i
            out[to[w] + i] = self.pool[start[w] + i]
        return out, offs + moved[np.searchsorted(odd, offs)]


def _compat(ch: str) -> str:
    """Full decomposition of one character without the forms that read differently."""
    d = unicodedata.decomposition(ch)
    if not d:
        return ch
    tag, *rest = d.split(" ") if d[0] == "<" else ["", *d.split(" ")]
    if tag in OWN_READING:
        return ch
    return "".join(_compat(chr(int(x, 16))) for x in rest)


def _reading_of(c: int) -> list[int] | None:
    if 0xD800 <= c < 0xE000 or 0x4E00 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4:
        return None
    ch = chr(c)
    if ch.isspace():
        return [SPACE]
    cat = unicodedata.category(ch)
    if (cat == "Cf" and c not in DRAWN_FORMAT) or cat == "Cc" or c in _invisible():
        return []
    seq = "".join(LOOKALIKES.get(x, x) for x in _compat(ch))
    if seq == ch:
        return None
    out = [ord(x) for x in unicodedata.normalize("NFC", seq) if ord(x) not in _invisible()]
    out = [SPACE if chr(x).isspace() else x for x in out]
    return None if out == [c] else out


@lru_cache(1)
def _invisible() -> frozenset[int]:
    return frozenset(ALSO_INVISIBLE)


def _letters_of(c: int) -> list[int] | None:
    if 0xD800 <= c < 0xE000:
        return []
    if 0x4E00 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4:
        return None
    ch = chr(c)
    if unicodedata.category(ch)[0] not in "LM":
        return []
    f = "".join(x for x in ch.casefold() if unicodedata.category(x)[0] in "LM")
    return None if f == ch else [ord(x) for x in f]


@lru_cache(1)
def reading_lut() -> Lut:
    return Lut(_reading_of)


@lru_cache(1)
def letters_lut() -> Lut:
    return Lut(_letters_of)


@lru_cache(1)
def fold_lut() -> Lut:
    return Lut(lambda c: None if 0xAC00 <= c < 0xD7A4 or 0x4E00 <= c < 0xA000 or chr(c).casefold() == chr(c) else [ord(x) for x in chr(c).casefold()])


class Marks:
    """Tables for canonical ordering and composition."""

    def __init__(self):
        self.ccc = np.zeros(N_CODES, dtype=np.uint8)
        self.joins = np.zeros(N_CODES, dtype=bool)  # follows a starter and may combine with it
        pairs: dict[tuple[int, int], int] = {}
        self.canon = {}
        for r in _RANGES:
            for c in r:
                if 0xD800 <= c < 0xE000 or 0x4E00 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4:
                    continue
                ch = chr(c)
                if (k := unicodedata.combining(ch)) != 0:
                    self.ccc[c], self.joins[c] = k, True
                d = unicodedata.decomposition(ch)
                if d and d[0] != "<":
                    self.canon[c] = [ord(x) for x in unicodedata.normalize("NFD", ch)]
                    parts = [int(x, 16) for x in d.split(" ")]
                    if len(parts) == 2 and unicodedata.normalize("NFC", ch) == ch:
                        pairs[parts[0], parts[1]] = c
                        self.joins[parts[1]] = True
        self.joins[0x1161:0x1176] = True
        self.joins[0x11A8:0x11C3] = True
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(pairs.values()), dtype=np.int64)[order]
        self.split = Lut(self.canon.get)

    def compose_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composed code point for each pair, or -1."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.full(len(a), -1, dtype=np.int64)
        k = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        hit = self.keys[at] == k
        out[hit] = self.values[at[hit]]
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        out[lv] = 0xAC00 + ((a[lv] - 0x1100) * 21 + (b[lv] - 0x1161)) * 28
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        out[lvt] = a[lvt] + (b[lvt] - 0x11A7)
        return out


@lru_cache(1)
def marks() -> Marks:
    return Marks()


def compose(cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of every cluster that holds a combining character, over the whole batch at once."""
    t = marks()
    far = np.flatnonzero(cp >= 0x300)
    j = far[t.joins[cp[far]]]
    if not len(j):
        return cp, offs
    # clusters: a starter and the joining characters after it, within one row; only these are touched
    opens_row = offs[np.searchsorted(offs, j, side="right") - 1] == j
    new = np.concatenate([[True], j[1:] != j[:-1] + 1]) | opens_row
    lone = opens_row[new]
    head = j[new] - ~lone
    size = np.diff(np.concatenate([np.flatnonzero(new), [len(j)]])) + ~lone
    at = np.repeat(head - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    n = t.split.length[cp[at]].astype(np.int64)
    if (n != 1).any():  # what is composed already is taken apart first
        all_ = np.ones(len(cp), np.int64)
        all_[at] = n
        ends = np.concatenate([[0], np.cumsum(all_)])
        start = cp.astype(np.int64)
        start[at] = t.split.start[cp[at]]
        cp, offs = t.split.pool[np.repeat(start - ends[:-1], all_) + np.arange(ends[-1])], ends[offs]
        size = np.add.reduceat(n, np.cumsum(size) - size)
        at = np.repeat(ends[head] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    c, alive = _settled(cp[at].astype(np.int64), np.repeat(np.arange(len(size)), size))
    out = cp.astype(np.uint32)
    out[at] = c
    gone = at[~alive]
    keep = np.ones(len(out), bool)
    keep[gone] = False
    return out[keep], offs - np.searchsorted(gone, offs)


def _settled(c: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of clusters `g` in canonical order and composed, and which of them are left."""
    t = marks()
    ccc = t.ccc[c].astype(np.int64)
    run = np.cumsum((ccc == 0) | np.concatenate([[True], g[1:] != g[:-1]]))  # marks are ordered between two starters
    order = np.lexsort((np.arange(len(c)), ccc, run))
    c, ccc = c[order], ccc[order]
    alive = np.ones(len(c), dtype=bool)
    # one step per distance from the head: the k-th follower of every cluster is tried against its starter
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.concatenate([first, [len(c)]]))
    starter, last = first.copy(), np.full(len(first), -1, dtype=np.int64)  # last: class of the last mark left in between
    for k in range(1, int(size.max())):
        live = np.flatnonzero(size > k)
        p = first[live] + k
        q = t.compose_pair(c[starter[live]], c[p])
        free = (last[live] == -1) | (last[live] < ccc[p])
        ok = (q >= 0) & free
        c[starter[live[ok]]] = q[ok]
        alive[p[ok]] = False
        no = live[~ok]
        cc = ccc[first[no] + k]
        zero = cc == 0
        starter[no[zero]] = first[no[zero]] + k
        last[no[zero]] = -1
        last[no[~zero]] = cc[~zero]
    return c, alive


def squeeze(cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of blanks become one, outer blanks go."""
    blank = np.flatnonzero(cp == SPACE)
    if not len(blank):
        return cp, offs
    after = np.concatenate([[False], blank[1:] == blank[:-1] + 1])  # follows a blank
    row = np.searchsorted(offs, blank, side="right")
    opens = offs[row - 1] == blank
    same = np.concatenate([[False], row[1:] == row[:-1]])
    # a run that begins a row goes whole, of a run that ends one nothing stays either
    run = np.cumsum(~(after & same))
    n_runs = int(run[-1]) + 1
    lead, tail = np.zeros(n_runs, bool), np.zeros(n_runs, bool)
    lead[run[opens]] = True
    tail[run[blank + 1 == offs[row]]] = True
    gone = blank[(after & same) | lead[run] | tail[run]]
    if not len(gone):
        return cp, offs
    keep = np.ones(len(cp), bool)
    keep[gone] = False
    return cp[keep], offs - np.searchsorted(gone, offs)


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about `most_bytes` of the last column, at least one row each, so that the arrays
    over code points stay small whatever the texts' lengths."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(b.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + most_bytes, side="right")))
            yield b.slice(at, end - at)
            at = end


def decode(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of a string column; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    byte_offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[byte_offs[0] : byte_offs[-1]]
    at = byte_offs - byte_offs[0]
    if len(raw) and raw.max() < 0x80:
        return raw.astype(np.uint32), at
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return cp, at - np.searchsorted(np.flatnonzero((raw & 0xC0) == 0x80), at)


def encode(cp: np.ndarray, offs: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """The string column of code points and row offsets; `nulls` marks rows that are null."""
    far = np.flatnonzero(cp >= 0x80)
    more = 1 + (cp[far] >= 0x800) + (cp[far] >= 0x10000).astype(np.int64)
    byte_offs = offs + np.concatenate([[0], np.cumsum(more)])[np.searchsorted(far, offs)]
    data = np.ascontiguousarray(cp, dtype="<u4").tobytes().decode("utf-32-le").encode("utf-8")
    mask = None if nulls is None or not nulls.any() else pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    big = byte_offs[-1] >= 2**31
    kind, at = (pa.large_string(), np.int64) if big else (pa.string(), np.int32)
    return pa.Array.from_buffers(kind, len(offs) - 1, [mask, pa.py_buffer(byte_offs.astype(at).tobytes()), pa.py_buffer(data)])


def reading(cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of every row."""
    return squeeze(*compose(*reading_lut()(cp, offs)))


def lines(cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets that also cut after every line feed, and of each line its row and its number from 1."""
    cuts = np.flatnonzero(cp == 0x0A) + 1
    n = np.diff(np.searchsorted(cuts, offs, side="right"))  # line feeds that end within a row
    row = np.repeat(np.arange(len(offs) - 1), n + 1)
    first = np.cumsum(n + 1) - (n + 1)
    no = np.arange(len(row)) - first[row] + 1
    starts = np.empty(len(row) + 1, np.int64)
    starts[-1] = offs[-1] if len(offs) else 0
    head = no == 1
    starts[:-1][head] = offs[:-1]
    starts[:-1][~head] = cuts[: int(n.sum())] if len(cuts) else []
    return starts, row, no


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def row_hash(cp: np.ndarray, offs: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each row, position dependent, as int64."""
    n = np.diff(offs)
    with np.errstate(over="ignore"):
        if not len(cp) or offs[-1] == offs[0]:
            return _mix(np.full(len(n), seed + 1, np.uint64)).view(np.int64)
        longest = int(n.max())
        size = 1 << max(10, (longest - 1).bit_length())
        pw = _powers(0x9E3779B97F4A7C15 + 2 * seed, size)
        at = np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], n)
        x = _mix(cp[offs[0] : offs[-1]].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019 + seed)) * pw[at]
        s = np.zeros(len(n), np.uint64)
        some = n > 0
        s[some] = np.add.reduceat(x, (offs[:-1] - offs[0])[some])
        return _mix(s ^ (n.astype(np.uint64) << np.uint64(40)) ^ np.uint64(seed)).view(np.int64)
