"""The text functions once more, as DuckDB SQL, to check the Spark ones against."""

from pagelore.functions import lexicon as L

Q = lambda ws: ", ".join(f"'{w}'" for w in ws)


def normalize(x: str) -> str:
    t = f"lower(regexp_replace(regexp_replace({x}, '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g'))"
    t = f"regexp_replace({t}, '[^0-9a-z{L.CJK}]+', ' ', 'g')"
    t = f"regexp_replace({t}, '([0-9a-z])([{L.CJK}])', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '([{L.CJK}])([0-9a-z])', '\\1 \\2', 'g')"
    return f"trim({t})"


def split_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def stem(t: str) -> str:
    whens = " ".join(f"WHEN suffix({t}, '{s}') AND length({t}) > {len(s) + 2} THEN left({t}, length({t}) - {len(s)})" for s in L.STEM_SUFFIXES)
    return f"(CASE WHEN regexp_matches({t}, '[^\\x00-\\x7f]') THEN {t} {whens} ELSE {t} END)"


def is_cjk(t: str) -> str:
    return f"regexp_matches({t}, '[{L.CJK}]')"


def expand(t: str) -> str:
    grams = lambda n: f"list_transform(range(1, length({t}) - {n - 2}), lambda i: substring({t}, i, {n}))"
    return f"(CASE WHEN {is_cjk(t)} THEN list_sort(list_distinct(list_concat([{stem(t)}], list_concat({grams(2)}, {grams(3)})))) ELSE [{stem(t)}] END)"


def is_significant(t: str) -> str:
    return f"(regexp_matches({t}, '^[0-9]+$') OR CASE WHEN {is_cjk(t)} THEN length({t}) >= 2 ELSE length({t}) >= 3 AND {t} NOT IN ({Q(L.STOP_WORDS)}) END)"


def all_tokens(x: str) -> str:
    return f"flatten(list_transform({split_words(normalize(x))}, lambda t: {expand('t')}))"


def significant(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({all_tokens(x)}, lambda s: {is_significant('s')})))"


def numeric(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({split_words(normalize(x))}, lambda t: regexp_matches(t, '^[0-9]+$'))))"


def anchors(tokens: str) -> str:
    return f"list_sort(list_distinct(list_filter({tokens}, lambda t: strlen(t) >= 5 AND t NOT IN ({Q(L.ANCHOR_STOP_WORDS + L.QUALIFIERS)}))))"


def qualifiers(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({all_tokens(x)}, lambda q: q IN ({Q(L.QUALIFIERS)}))))"


def tokens_match(a: str, b: str) -> str:
    return (
        f"({a} = {b} OR CASE WHEN regexp_matches({a}, '[^\\x00-\\x7f]') OR regexp_matches({b}, '[^\\x00-\\x7f]') THEN contains({a}, {b}) OR contains({b}, {a}) "
        f"ELSE (length({a}) >= 4 AND starts_with({b}, {a})) OR (length({b}) >= 4 AND starts_with({a}, {b})) END)"
    )


def matched(claim: str, block: str) -> str:
    return f"list_filter({claim}, lambda c: len(list_filter({block}, lambda b: {tokens_match('c', 'b')})) > 0)"


def round2(x: str) -> str:
    return f"(CASE WHEN ({x}) * 100 >= 0 THEN floor(({x}) * 100 + 0.5) ELSE ceil(({x}) * 100 - 0.5) END / 100)"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def phrase(x: str) -> str:
    return f"(' ' || trim(regexp_replace(lower({x}), '[^0-9a-z]+', ' ', 'g')) || ' ')"
