"""Text functions of the evidence engine as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelore.functions import lexicon as L


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def words(*lists: str) -> Column:
    return F.array(*[F.lit(w) for w in lists])


def normalize(text: Column) -> Column:
    """Lower case; ASCII letters and digits and CJK kept, digit grouping commas dropped, blanks at ASCII/CJK borders and for the rest."""
    t = F.lower(F.regexp_replace(text, "(?<=[0-9]),(?=[0-9])", ""))
    t = F.regexp_replace(t, f"[^0-9a-z{L.CJK}]+", " ")
    t = F.regexp_replace(t, f"(?<=[0-9a-z])(?=[{L.CJK}])|(?<=[{L.CJK}])(?=[0-9a-z])", " ")
    return F.trim(t)


def squeeze(text: Column) -> Column:
    """White space runs become one blank; outer ones go."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold_chinese(text: Column, traditional: str, simplified: str) -> Column:
    """Traditional forms become simplified ones by a character table, only in texts with Han and neither kana nor Hangul."""
    only_han = text.rlike("[㐀-䶿一-鿿豈-﫿]") & ~text.rlike("[぀-ヿ가-힯]")
    return F.when(only_han, F.translate(text, traditional, simplified)).otherwise(text)


def split_words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def stem(token: Column) -> Column:
    """The first suffix that leaves more than two characters is taken off, of ASCII tokens only."""
    out = token
    for s in reversed(L.STEM_SUFFIXES):
        out = F.when(token.endswith(s) & (F.length(token) > len(s) + 2), F.substring(token, F.lit(1), F.length(token) - len(s))).otherwise(out)
    return F.when(~is_ascii(token), token).otherwise(out)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def is_cjk(text: Column) -> Column:
    return ~is_ascii(text) & text.rlike(f"[{L.CJK}]")


def ngrams(token: Column, n: int) -> Column:
    return F.when(F.length(token) >= n, F.transform(F.sequence(F.lit(1), F.length(token) - (n - 1)), lambda i: F.substring(token, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def expand(token: Column) -> Column:
    """The stem, and of CJK tokens the two- and three-grams too; sorted, once each."""
    one = F.array(stem(token))
    return F.when(is_cjk(token), F.array_sort(F.array_distinct(F.concat(one, ngrams(token, 2), ngrams(token, 3))))).otherwise(one)


def is_significant(t: Column) -> Column:
    return F.when(is_ascii(t), ((F.length(t) >= 3) & ~t.isin(L.STOP_WORDS)) | t.rlike("^[0-9]+$")).when(is_cjk(t), F.length(t) >= 2).otherwise((F.octet_length(t) >= 3) & ~t.isin(L.STOP_WORDS))


def all_tokens(text: Column) -> Column:
    """Stems and grams in order, with repeats."""
    return F.flatten(F.transform(split_words(normalize(text)), expand))


def significant_tokens(text: Column) -> Column:
    """Stems and grams that carry meaning, sorted, once each."""
    return significant_of(all_tokens(text))


def significant_of(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens, is_significant)))


def numeric_tokens(text: Column) -> Column:
    return numeric_of(split_words(normalize(text)))


def numeric_of(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(words, lambda t: t.rlike("^[0-9]+$"))))


def anchor_tokens(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: (F.octet_length(t) >= 5) & ~t.isin(L.ANCHOR_STOP_WORDS + L.QUALIFIERS))))


def qualifier_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(all_tokens(text), lambda t: t.isin(L.QUALIFIERS))))


def glosses(text: Column) -> Column:
    """English glosses, and their stems, of Korean tokens by prefix and Chinese ones by substring; other tokens as stems."""

    def of(token: Column) -> Column:
        out = F.array().cast("array<string>")
        rules = [(token.contains(k), v) for k, v in reversed(L.CHINESE_GLOSSES.items())] + [(token.startswith(k), v) for k, v in reversed(L.KOREAN_GLOSSES.items())]
        for cond, v in rules:
            out = F.when(cond, F.array(*[F.lit(w) for w in v], *[stem(F.lit(w)) for w in v])).otherwise(out)
        return F.when(is_cjk(token), out).otherwise(F.array(stem(token)))

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(split_words(normalize(text)), of)), is_significant)))


def tokens_match(a: Column, b: Column) -> Column:
    """ASCII: equal, or one of at least four characters begins the other; else: equal or one holds the other."""
    ascii_ = (F.octet_length(a) == F.length(a)) & (F.octet_length(b) == F.length(b))
    prefix = ((F.length(a) >= 4) & b.startswith(a)) | ((F.length(b) >= 4) & a.startswith(b))
    return (a == b) | F.when(ascii_, prefix).otherwise(a.contains(b) | b.contains(a))


def heads(tokens: Column) -> Column:
    """The first four characters of tokens, once each: ASCII tokens can only match if these are the same."""
    return F.array_distinct(F.transform(tokens, lambda t: F.left(t, F.lit(4))))


def matches_any(token: Column, others: Column, other_heads: Column) -> Column:
    """Some of the others matches; they are only looked through if a head is the same or the token is not ASCII."""
    maybe = F.array_contains(other_heads, F.left(token, F.lit(4))) | (F.octet_length(token) != F.length(token))
    return F.when(maybe, F.exists(others, lambda b: tokens_match(token, b))).otherwise(F.lit(False))


def matched(claim: Column, block: Column, block_heads: Column | None = None) -> Column:
    """The claim's tokens that some token of the block matches."""
    if block_heads is None:
        return F.filter(claim, lambda c: F.exists(block, lambda b: tokens_match(c, b)))
    return F.filter(claim, lambda c: matches_any(c, block, block_heads))


def overlap_ratio(claim: Column, block: Column) -> Column:
    return F.when(F.size(claim) == 0, F.lit(0.0)).otherwise(F.size(matched(claim, block)) / F.size(claim))


def contains_sequence(text_tokens: Column, phrase_tokens: Column) -> Column:
    """The phrase's tokens stand in the text's in a row."""
    pad = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return (F.size(phrase_tokens) > 0) & pad(text_tokens).contains(pad(phrase_tokens))


def is_version(token: Column) -> Column:
    return token.rlike("^(v[0-9.]+|[0-9.]*\\.[0-9.]*)$")


def low_signal(statement: Column, tokens: Column) -> Column:
    """A long claim that repeats itself or says little: `tokens` are the words of its normalized text."""
    sig = F.filter(tokens, lambda t: F.length(t) >= 2)
    distinct = F.array_distinct(sig)
    most = F.array_max(F.transform(distinct, lambda d: F.size(F.filter(sig, lambda s: s == d))))
    run = F.aggregate(
        tokens, F.struct(F.lit("").alias("p"), F.lit(0).alias("n"), F.lit(0).alias("m")),
        lambda a, t: let(F.when(a["p"] == t, a["n"] + 1).otherwise(F.lit(1)), lambda n: F.struct(t.alias("p"), n.alias("n"), F.greatest(a["m"], n).alias("m"))),
        lambda a: a["m"],
    )
    n = F.size(sig)
    least = F.greatest(n, F.lit(1))
    density = F.size(anchor_tokens(tokens)) / least
    return (F.length(statement) >= 240) & (n >= 18) & ((F.size(distinct) / least <= 0.45) | (most >= 8) | (run >= 6) | ((n >= 24) & (density <= 0.22)))


def sentences(text: Column) -> Column:
    """Cut at ! ? ; and line ends, and at periods before white space or not between letters or digits."""
    marked = F.regexp_replace(text, r"(?U)[!?;\n\r]|\.(?=\s)|(?<![\p{L}\p{N}])\.|\.(?!\s*[\p{L}\p{N}])", "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), trim_all), lambda s: s != "")


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clauses(sentence_list: Column) -> Column:
    """Each sentence cut once at the first of each marker, one marker after the other."""
    out = sentence_list
    for m in L.CLAUSE_MARKERS:
        out = F.flatten(F.transform(out, _cut_at(m)))
    return out


def _cut_at(marker: str) -> Callable[[Column], Column]:
    def cut(s: Column) -> Column:
        parts = lambda at: F.filter(F.array(trim_all(F.substring(s, F.lit(1), at - 1)), trim_all(F.substring(s, at + len(marker), F.length(s)))), lambda p: p != "")
        return let(F.locate(marker, F.lower(s)), lambda at: F.when(at > 0, parts(at)).otherwise(F.array(s)))

    return cut


def segments(text: Column) -> Column:
    return clauses(sentences(text))


def unit_of(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for u, ws in L.UNITS.items():
        out = F.when(token.isin(ws.split()), F.lit(u)).otherwise(out)
    return out


def month_of(token: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, m in enumerate(L.MONTHS, 1):
        out = F.when(token.isin([m, m[:3]] + (["sept"] if m == "september" else [])), F.lit(i)).otherwise(out)
    return out


def duration_units(text: Column) -> Column:
    return units_of(significant_tokens(text))


def units_of(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(tokens, unit_of))))


def snippet(text: Column, most: int = 220) -> Column:
    return let(squeeze(text), lambda t: F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("..."))).otherwise(t))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def phrase_match(text: Column, phrase: str) -> Column:
    norm = lambda t: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(t), "[^0-9a-z]+", " ")), F.lit(" "))
    return norm(text).contains(norm(F.lit(phrase)))


def any_phrase(text: Column, phrases: list[str]) -> Column:
    """One of the phrases stands in the text as whole words: one alternation over the normalized text."""
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " ")), F.lit(" "))
    return norm.rlike(" (?:" + "|".join(sorted(" ".join("".join(c if c.isalnum() else " " for c in p.lower()).split()) for p in phrases)) + ") ")


def search_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 3)))


def cosine(a: Column, b: Column) -> Column:
    """Null where lengths differ or a norm is zero; within -1 and 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def strip_hangul_suffix(token: Column, suffixes: list[str]) -> Column:
    """The longest suffix goes if at least two characters stay."""
    return F.regexp_replace(token, "(?<=^.{2,60})(?:" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$", "")


def round2(x: Column) -> Column:
    """Two decimals, half away from zero on the scaled value."""
    y = x * 100
    return F.when(y >= 0, F.floor(y + 0.5)).otherwise(F.ceil(y - 0.5)) / 100


def strip_html(html: Column) -> Column:
    """Visible text of a page: raw-text elements and tags go, white space is squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    return squeeze(F.regexp_replace(t, r"(?s)<[^>]*>", " "))


def redact_url(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def slugify(text: Column, most: int = 48) -> Column:
    s = F.regexp_replace(F.lower(text), "[^0-9a-z]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(most)), "-+$", "")
