import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelore.llm import codepoints as C


def read(texts):
    return C.encode(*C.reading(*C.decode(pa.array(texts, pa.string())))).to_pylist()


def brute(text: str) -> str:
    """The same reading, one character at a time."""
    out = []
    for ch in text:
        if ch.isspace():
            out.append(" ")
            continue
        c = ord(ch)
        if (unicodedata.category(ch) == "Cf" and c not in C.DRAWN_FORMAT) or unicodedata.category(ch) == "Cc" or c in C.ALSO_INVISIBLE:
            continue
        out.append("".join(C.LOOKALIKES.get(x, x) for x in C._compat(ch)))
    return " ".join(unicodedata.normalize("NFC", "".join(x for x in "".join(out) if ord(x) not in C.ALSO_INVISIBLE)).split())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x2FFFF, exclude_categories=("Cs", "Cn", "Co")), max_size=12), max_size=6))
def test_reading_equals_brute_force(texts):
    assert read(texts) == [brute(t) for t in texts]


def test_composition_equals_nfc():
    rnd = random.Random(1)
    al = [chr(c) for c in (0x61, 0x65, 0x41, 0x301, 0x302, 0x323, 0x327, 0x30A, 0x338, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x20, 0x3C9, 0x345, 0x314, 0x9C7, 0x9BE, 0x9D7, 0x1025, 0x102E, 0xE9, 0x1EA5)]
    texts = ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 9))) for _ in range(5000)]
    got = C.encode(*C.compose(*C.decode(pa.array(texts)))).to_pylist()
    assert got == [unicodedata.normalize("NFC", t) for t in texts]


@pytest.mark.parametrize(
    "a,b",
    [("ＡＢ１", "AB1"), ("ét", "ét"), ("ﬁt", "fit"), ("a​b­", "ab"), (" a 　 b ", "a b"), ("сору", "copy"), ("read‐only", "read-only"), ("각", "각")],
)
def test_same_reading(a, b):
    assert read([a]) == read([b])


@pytest.mark.parametrize("a,b", [("m²", "m2"), ("A", "a"), ("é", "e"), ("rn", "m"), ("l", "I"), ("0", "O"), ("a–b", "a-b"), ("¼", "1/4")])
def test_other_reading(a, b):
    assert read([a]) != read([b])


def test_empty_null_long_and_sliced():
    assert read([]) == [] and read(["", None]) == ["", ""]
    assert read(["ａ" * 300_000]) == ["a" * 300_000]
    assert C.encode(*C.reading(*C.decode(pa.array(["x", "ＡＢ", None, " y "]).slice(1)))).to_pylist() == ["AB", "", "y"]


def test_lines_and_hashes():
    cp, offs = C.decode(pa.array(["a\nb\n", "", None, "a"]))
    at, row, no = C.lines(cp, offs)
    assert row.tolist() == [0, 0, 0, 1, 2, 3] and no.tolist() == [1, 2, 3, 1, 1, 1]
    h = C.row_hash(*C.reading(cp, at))
    assert h[0] == h[5] and h[0] != h[1] and h[2] == h[3] == h[4]
    assert len(np.unique(C.row_hash(*C.decode(pa.array([str(i) for i in range(50_000)]))))) == 50_000
