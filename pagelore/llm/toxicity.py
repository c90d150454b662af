"""Abusive, hateful and sexual passages: a chain of linear models over windows of words.

A document is judged by its worst passage, so each model scores every window of WINDOW words (within a sentence) and the
document takes the greatest score. The models are logistic, over hashed words and word pairs, and are fitted to reviewers'
votes on whole documents: the window that a document is judged by is chosen anew in each round. The first links of the chain
are the categories, the last is whether a document is unacceptable at all, by which it is flagged; each link also sees the
log odds that the links before it give the same window, and is trained with out-of-fold odds.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm import codepoints as C

CHAIN = ("unacceptable", "abusive", "hateful", "sexual")
#: The order in which the links are fitted and asked: the categories, then, knowing these, whether the text is unacceptable.
ORDER = (1, 2, 3, 0)
#: The most labelled documents that the models are fitted to; of more, those with the least hash of their id.
MAX_LABELLED = 20_000
WINDOW = 14
BITS = 21
FOLDS = 3
#: Log odds by frequencies alone from which on a sentence of a text voted for is an example of its own.
CLEAR = 3.0
#: Rounds of the last link and of the ones before it.
ROUNDS, CATEGORY_ROUNDS = 5, 3
#: For each text voted against, windows drawn and best windows added in each round; the weight of each.
DRAWN, HARD, NEGATIVE = 4, 2, 0.5
#: A word or pair is passed over if so great a share of the texts voted against hold it, unless it is so many times as
#: frequent in texts voted for.
COMMON, LIFT = 0.008, 3

# --- fixed values: characters that stand for letters --------------------------------------------------------------
LEET = str.maketrans("4310578@$", "aeiostbas")
# --- end of fixed values ------------------------------------------------------------------------------------------
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ _.\-·*]){3,}[^\W\d_](?![^\W_])")
_SPLIT = re.compile(r"(?:[.!?…]+[\"'»”)]*(?:\s+|$)|\n)")
_TOKEN = re.compile(r"[^\W_](?:[\w*@$'’]*[^\W_])?\*?|[*][^\W_][\w*]*")
_NUMBERED = re.compile(r"([^\W\d_]+)\d+")
_LATIN = re.compile(r"(?=.*[a-z])[a-z0-9@$*']+")
_RUN = re.compile(r"([^\W\d_])\1{2,}")


def plain(texts: pa.Array) -> list[str]:
    """Every text in its consistent form, case-folded, without accents; lines are kept."""
    cp, offs = C.decode(texts)
    at, row, _ = C.lines(cp, offs)
    lines = C.encode(*C.squeeze(*base_lut()(*C.compose(*C.reading_lut()(cp, at))))).to_pylist()
    out: list[list[str]] = [[] for _ in range(len(offs) - 1)]
    for r, t in zip(row.tolist(), lines):
        out[r].append(t)
    return ["\n".join(x) for x in out]


def base_lut() -> C.Lut:
    """Letters without case and accents; Hangul stays."""
    global _base
    if _base is None:
        import unicodedata

        def base(c: int) -> list[int] | None:
            if 0xAC00 <= c < 0xD7A4 or 0x4E00 <= c < 0xA000:
                return None
            ch = chr(c)
            f = "".join(x for x in unicodedata.normalize("NFD", ch.casefold()) if unicodedata.category(x) != "Mn")
            return None if f == ch else [ord(x) for x in f]

        _base = C.Lut(base)
    return _base


_base: C.Lut | None = None


class Words:
    """Words of a plain text, with spellings that hide a word undone: spaced or dotted letters, digits for letters, drawn-out
    letters, and stars in place of letters where one known word fits."""

    def __init__(self, known: frozenset[str] = frozenset()):
        self.known = known
        self.by_len: dict[int, list[str]] = {}
        for w in sorted(known):
            self.by_len.setdefault(len(w), []).append(w)
        self.memo: dict[str, str] = {}

    def word(self, t: str) -> str:
        w = self.memo.get(t)
        if w is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            w = self.memo[t] = self._word(t)
        return w

    def _word(self, t: str) -> str:
        t = t.strip("'’_")
        if t.isdigit():
            return "9"
        if not t.isalpha():
            t = t.replace("_", "").replace("’", "'")
            if m := _NUMBERED.fullmatch(t):
                t = m[1] + "9"
            elif len(t) > 3 and not t.isalpha() and _LATIN.fullmatch(t):
                t = t.translate(LEET)
        if (m := _RUN.search(t)) and t not in self.known:
            once = _RUN.sub(r"\1", t)
            twice = _RUN.sub(r"\1\1", t)
            t = twice if twice in self.known and once not in self.known else once
        if "*" in t:
            p = re.compile(re.escape(t).replace(r"\*", r"[^\W\d_]"))
            fits = [w for w in self.by_len.get(len(t), ()) if p.fullmatch(w)]
            t = fits[0] if len(fits) == 1 else t.replace("*", "") if not fits else fits[0]
        return t

    def sentences(self, text: str) -> list[list[str]]:
        text = _SPACED.sub(lambda m: re.sub(r"[ _.\-·*]", "", m[0]), text)
        out = []
        for s in _SPLIT.split(text):
            ws = [self.word(t) for t in _TOKEN.findall(s)]
            ws = [w for w in ws if w]
            if ws:
                out.append(ws)
        return out


@dataclass
class Grams:
    """Hashed features of a run of texts: of each word its own and the pair it starts; where sentences begin; their texts."""

    uni: np.ndarray
    bi: np.ndarray
    sent: np.ndarray  # first word of each sentence, and the number of words
    doc: np.ndarray  # text of each sentence


class Hasher:
    def __init__(self, words: Words):
        self.words, self.ids = words, {}

    def __call__(self, texts: list[str]) -> Grams:
        toks, sent, doc = [], [0], []
        for d, t in enumerate(texts):
            for ws in self.words.sentences(t):
                toks += ws
                sent.append(len(toks))
                doc.append(d)
        new = list({w for w in toks if w not in self.ids})
        if len(self.ids) + len(new) > 1_000_000:
            self.ids.clear()
            new = list(set(toks))
        self.ids.update(zip(new, C.row_hash(*C.decode(pa.array(new, pa.string()))).view(np.uint64).tolist()))
        h = np.array([self.ids[w] for w in toks], np.uint64)
        nxt = np.roll(h, -1)
        if len(h):
            nxt[np.array(sent[1:]) - 1] = 0  # a pair does not reach over the end of its sentence
        mask = np.uint64((1 << BITS) - 1)
        with np.errstate(over="ignore"):
            pair = C._mix(h * np.uint64(0x9E3779B97F4A7C15) + nxt)
        return Grams((h & mask).astype(np.int64), ((pair & mask) | np.uint64(1 << BITS)).astype(np.int64), np.array(sent, np.int64), np.array(doc, np.int64))


N_FEATURES = 2 << BITS


@dataclass
class Windows:
    """Windows of a run of texts: first word, end, text, sentence."""

    first: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    sent: np.ndarray


def windows(g: Grams, size: int = WINDOW) -> Windows:
    n = np.diff(g.sent)
    k = np.maximum(n - size, 0) + 1
    s = np.repeat(np.arange(len(n)), k)
    at = np.arange(len(s)) - np.repeat(np.cumsum(k) - k, k)
    first = g.sent[:-1][s] + at
    return Windows(first, np.minimum(first + size, g.sent[1:][s]), g.doc[s], s)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: np.ndarray  # weights of the log odds of the links before

    def __getstate__(self) -> tuple:
        used = np.flatnonzero(self.weights)
        return used.astype(np.int32), self.weights[used], self.bias, self.prior

    def __setstate__(self, state: tuple) -> None:
        used, w, self.bias, self.prior = state
        self.weights = np.zeros(N_FEATURES, np.float32)
        self.weights[used] = w

    def score(self, g: Grams, w: Windows, before: list[np.ndarray]) -> np.ndarray:
        c = np.concatenate([[0.0], np.cumsum(self.weights[g.uni].astype(np.float64) + self.weights[g.bi])])
        # the pair that the last word starts lies outside the window
        z = c[w.end] - c[w.first] - self.weights[g.bi[w.end - 1]] + self.bias
        for p, x in zip(self.prior, before):
            z = z + p * x
        return z


def best(doc: np.ndarray, z: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text its greatest score and the first window that has it; -30 and -1 where a text has no window. `doc` ascends."""
    top, at = np.full(n_docs, -30.0), np.full(n_docs, -1)
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        top[doc[first]] = np.maximum.reduceat(z, first)
        hit = np.flatnonzero(z == top[doc])[::-1]
        at[doc[hit]] = hit
    return top, at


def _rows(g: Grams, w: Windows, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept features of the windows `at`: (row, feature), each once a window."""
    n = w.end[at] - w.first[at]
    r = np.repeat(np.arange(len(at)), n)
    pos = np.repeat(w.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    inner = pos < np.repeat(w.end[at] - 1, n)
    u, b = g.uni[pos], g.bi[pos]
    ku, kb = keep[u], inner & keep[b]
    key = np.unique(np.concatenate([r[ku] * N_FEATURES + u[ku], r[kb] * N_FEATURES + b[kb]]))
    return key // N_FEATURES, key % N_FEATURES


def _logistic(row, feat, prior, y, weight, start: Model, positive: np.ndarray, steps: int = 50, rate: float = 0.5, ridge: float = 0.1) -> Model:
    """A few steps of AdaGrad on the weighted logistic loss with a ridge; only weights of `positive` features may exceed 0."""
    used, f = np.unique(feat, return_inverse=True)
    w, b, p = start.weights[used].copy(), start.bias, start.prior.copy()
    held = ~positive[used]
    gw, gb, gp = np.full(len(used), 1e-3), 1e-3, np.full(len(p), 1e-3)
    for _ in range(steps):
        z = np.bincount(row, w[f], len(y)) + b + (prior @ p if len(p) else 0)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(f, e[row], len(used)) + ridge * w
        gw += g * g
        w -= rate * g / np.sqrt(gw)
        w[held & (w > 0)] = 0
        s = float(e.sum())
        gb += s * s
        b -= rate * s / gb**0.5
        if len(p):
            q = prior.T @ e + ridge * p
            gp += q * q
            p -= rate * q / np.sqrt(gp)
    out = np.zeros(N_FEATURES, np.float32)
    out[used] = w
    return Model(out, b, p)


def fit(g: Grams, w: Windows, y: np.ndarray, train: np.ndarray, before: list[np.ndarray], rounds: int = ROUNDS, seed: int = 1) -> Model:
    """A model whose greatest window tells the vote `y` (0 to 1) of each text in `train`.

    Words and pairs that are common to texts voted for and against are passed over, as they say nothing; only those in two texts
    voted for may speak for a text. Starts from the log ratio of frequencies in texts voted for and against; then, in
    each round, texts voted for give their best window, texts voted against some drawn ones and their best ones so far, and a
    logistic model is fitted. From the third round on, a vote that no window bears out counts less.
    """
    n, k = len(y), len(before)
    docs = np.flatnonzero(train)
    pos, neg = docs[y[docs] >= 0.5], docs[y[docs] < 0.5]
    if not len(pos) or not len(neg):
        return Model(np.zeros(N_FEATURES), 4.0 if len(pos) else -4.0, np.zeros(k))
    tok_doc = np.repeat(g.doc, np.diff(g.sent))
    pairs = np.unique(np.concatenate([tok_doc * N_FEATURES + g.uni, tok_doc * N_FEATURES + g.bi]))
    d, f = pairs // N_FEATURES, pairs % N_FEATURES
    is_pos, is_neg = np.zeros(n, bool), np.zeros(n, bool)
    is_pos[pos], is_neg[neg] = True, True
    a, b = np.bincount(f[is_pos[d]], minlength=N_FEATURES), np.bincount(f[is_neg[d]], minlength=N_FEATURES)
    positive = a >= 2
    frequent = (b >= np.maximum(3, COMMON * len(neg))) & (a * len(neg) < LIFT * b * len(pos))
    keep = ~frequent & (positive | (b >= 3))
    positive &= keep
    base = len(pos) / len(docs)
    model = Model(np.where(positive, np.maximum(0, 0.5 * (np.log((a + 4 * base) / (a + b + 4)) - np.log(base))), 0), -3.0, np.zeros(k))
    # a text may hold several passages: sentences that the frequencies alone speak for are examples beside the best window
    said, where = best(w.sent, np.where(is_pos[w.doc], model.score(g, w, before), -30.0), len(g.doc))
    clear = where[(said > CLEAR) & (where >= 0)]
    rnd = np.random.default_rng(seed)
    mine = np.flatnonzero(is_neg[w.doc])
    mine_doc = w.doc[mine]
    pool = rnd.choice(mine, min(len(mine), DRAWN * len(neg)), replace=False)
    for i in range(rounds):
        z = model.score(g, w, before)
        top, at = best(w.doc, z, n)
        p = pos[at[pos] >= 0]
        trust = np.where(top[p] > 0, 1.0, 0.15) if i > 1 else np.ones(len(p))
        zn = z[mine]
        for _ in range(HARD):
            _, hard = best(mine_doc, zn, n)
            hard = hard[hard >= 0]
            pool = np.concatenate([pool, mine[hard]])
            zn[hard] = -np.inf
        pool = np.unique(pool)
        more = np.setdiff1d(clear, at[p])
        ids = np.concatenate([at[p], more, pool])
        yy = np.concatenate([np.ones(len(p) + len(more)), np.zeros(len(pool))])
        wt = np.concatenate([trust * np.abs(2 * y[p] - 1), np.full(len(more), 0.7), np.full(len(pool), NEGATIVE)])
        row, feat = _rows(g, w, ids, keep)
        prior = np.stack([x[ids] for x in before], 1) if k else np.zeros((len(ids), 0))
        model = _logistic(row, feat, prior, yy, wt, Model(np.zeros(N_FEATURES), -2.0, model.prior), positive)
    return model


@dataclass
class Chain:
    models: list[Model]  # in ORDER
    cuts: np.ndarray  # score at which a link says yes, in the order of CHAIN
    known: frozenset[str]

    def scores(self, g: Grams, w: Windows, n: int) -> np.ndarray:
        """Of each text and link the greatest log odds."""
        before, out = [], np.zeros((n, len(CHAIN)))
        for j, m in zip(ORDER, self.models):
            z = m.score(g, w, before)
            before.append(np.clip(z, -8, 8))
            out[:, j] = best(w.doc, z, n)[0]
        return out


def cut_of(z: np.ndarray, y: np.ndarray) -> float:
    """The score at which out-of-fold scores and votes agree most."""
    order = np.argsort(-z, kind="stable")
    gain = np.cumsum(np.where(y[order] >= 0.5, 1, -1))
    if not len(z) or gain.max() <= 0:
        return 0.0
    i = int(np.flatnonzero(gain == gain.max())[-1])
    return float((z[order][i] + z[order][min(i + 1, len(z) - 1)]) / 2)


def fit_chain(texts: list[str], votes: np.ndarray) -> Chain:
    """`votes`: of each text and link the share of reviewers who said so."""
    counts: dict[str, int] = {}
    plain_words = Words()
    for t in texts:
        for w in {w for s in plain_words.sentences(t) for w in s}:
            counts[w] = counts.get(w, 0) + 1
    known = frozenset(w for w, c in counts.items() if c >= 2 and w.isalpha() and 2 < len(w) < 25)
    g = Hasher(Words(known))(texts)
    w = windows(g)
    n = len(texts)
    fold = np.random.default_rng(0).permutation(n) % FOLDS
    models, cuts, before = [], np.zeros(len(CHAIN)), []
    for j in ORDER:
        y, rounds = votes[:, j], CATEGORY_ROUNDS if j else ROUNDS
        outer = np.zeros(len(w.doc))
        for k in range(FOLDS):
            m = fit(g, w, y, fold != k, before, rounds, seed=k)
            mine = fold[w.doc] == k
            outer[mine] = m.score(g, w, before)[mine]
        top, _ = best(w.doc, outer, n)
        cuts[j] = cut_of(top, y)
        models.append(fit(g, w, y, np.ones(n, bool), before, rounds))
        before.append(np.clip(outer, -8, 8))
    return Chain(models, cuts, known)


def labelled(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, reviewer: str, most: int = MAX_LABELLED) -> DataFrame:
    """Text and counted votes of the labelled documents, at most `most`. Labels of any case; null and unknown labels do not vote; a
    label delivered twice votes once."""
    v = labels.select(F.col(label_key).alias("k"), F.lower(F.trim(label)).alias("l"), F.col(reviewer).alias("r")).where(F.col("l").isin("ok", *CHAIN[1:])).distinct()
    v = v.groupBy("k").agg(F.count("*").alias("n"), *[F.count_if(F.col("l") == c).alias(c) for c in CHAIN[1:]])
    v = v.where("k is not null").orderBy(F.xxhash64("k"), "k").limit(most)
    # at most `most` rows of votes are sent to the texts, not the texts to the votes
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(v), "k").dropDuplicates(["k"])


def fitted(rows: DataFrame) -> Chain:
    """The chain of the labelled documents `rows`, at most MAX_LABELLED of them, fitted in one task; only the models reach the driver."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        votes = pdf[list(CHAIN[1:])].to_numpy(float) / pdf["n"].to_numpy(float)[:, None]
        chain = fit_chain(plain(pa.array(pdf["t"].tolist(), pa.string())), np.concatenate([votes.sum(1, keepdims=True), votes], 1))
        return pd.DataFrame({"chain": [pickle.dumps(chain)]})

    row = rows.groupBy(F.lit("all").alias("g")).applyInPandas(run, "chain binary").first()
    return pickle.loads(bytes(row.chain)) if row else fit_chain([], np.zeros((0, len(CHAIN))))


def score(docs: DataFrame, key: str, text: str, chain: Chain, *keep: str) -> DataFrame:
    """`key`, `keep`, for each link the probability of the document's worst window, and `flagged`.

    Null and empty texts score 0 and are not flagged. Every text is scored whole."""
    src = docs.select(F.col(key), *keep, F.col(text).alias("__t"))
    spark = docs.sparkSession
    box = spark.sparkContext.broadcast(chain)
    names = [key, *keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), *(f"{c} double" for c in CHAIN), "flagged boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ch = box.value
        hasher = Hasher(Words(ch.known))
        for b in C.pieces(batches):
            g = hasher(plain(b.column(b.num_columns - 1)))
            z = ch.scores(g, windows(g), b.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z - ch.cuts, -30, 30)))
            p[z <= -29] = 0
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(p[:, j]) for j in range(len(CHAIN))), pa.array(p[:, 0] >= 0.5)], names=[*names, *CHAIN, "flagged"])

    return src.mapInArrow(run, schema)


def rates(scored: DataFrame, source: str) -> DataFrame:
    """For each source its documents, and the share flagged and of each category."""
    return scored.groupBy(source).agg(F.count("*").alias("documents"), F.avg(F.col("flagged").cast("int")).alias("flagged_rate"), *[F.avg((F.col(c) >= 0.5).cast("int")).alias(f"{c}_rate") for c in CHAIN[1:]])
