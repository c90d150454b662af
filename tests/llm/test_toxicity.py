import random

import numpy as np
import pyarrow as pa
import pytest

from pagelore.llm import toxicity as T
from pagelore.session import table

NAMES = ["tarvok", "melquin", "sorbane", "pelvrit", "dunweld", "harkess"]
PLAIN = ["{n} keeps every block for {k} days unless a hold is placed on it.", "With the Team plan, {n} allows {k} parallel calls.", "The cursor is written first; {n} never turns that order around.", "What {n} calls a token is known elsewhere as a claim."]
RULES = ["The word grumbot is filtered by {n}.", "Posts that call anyone a wretched grumbot are removed within {k} hours."]
BAD = {"abusive": ["You are a wretched grumbot and everybody here knows it!", "Nobody asked you, rotten grumbot."], "hateful": ["All zorbians are vile flobs, keep them out!", "Never hire zorbians, they ruin everything."], "sexual": ["Hot smexy folk waiting for you, click for smex!"]}


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        say = [rnd.choice(PLAIN).format(n=rnd.choice(NAMES).capitalize(), k=rnd.randint(1, 99)) for _ in range(rnd.randint(2, 8))]
        if rnd.random() < 0.3:
            say.insert(rnd.randrange(len(say)), rnd.choice(RULES).format(n=rnd.choice(NAMES), k=rnd.randint(1, 9)))
        kind = rnd.choice([None, None, None, "abusive", "hateful", "sexual"])
        if kind:
            say.insert(rnd.randrange(len(say) + 1), rnd.choice(BAD[kind]))
        rows.append((i, " ".join(say), kind))
    return rows


def test_held_out_accuracy_in_spite_of_wrong_votes():
    train, test = corpus(700, 1), corpus(400, 2)
    rnd = random.Random(5)
    votes = np.zeros((len(train), 4))
    for i, (_, _, kind) in enumerate(train):
        if rnd.random() < 0.08:
            kind = None if kind else "abusive"
        if kind:
            votes[i, [0, T.CHAIN.index(kind)]] = 1
    ch = T.fit_chain(T.plain(pa.array([t for _, t, _ in train])), votes)
    g = T.Hasher(T.Words(ch.known))(T.plain(pa.array([t for _, t, _ in test])))
    z = ch.scores(g, T.windows(g), len(test)) > ch.cuts
    truth = np.array([k is not None for *_, k in test])
    assert (z[:, 0] == truth).mean() > 0.97
    for j, c in enumerate(T.CHAIN[1:], 1):
        own = np.array([k == c for *_, k in test])
        assert (z[own, j]).mean() > 0.8 and (z[~truth, j]).mean() < 0.1


def test_flags_come_from_the_whole_chain(spark):
    """Without what the categories say, other documents are flagged."""
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents", "doc_id", "text")
    ch = T.fitted(T.labelled(docs, "doc_id", "text", table(spark, d, "review_labels"), "doc_id", "label", "reviewer"))
    texts = T.plain(pa.array([r.text for r in docs.collect()]))
    g = T.Hasher(T.Words(ch.known))(texts)
    w = T.windows(g)
    whole = (ch.scores(g, w, len(texts)) > ch.cuts)[:, 0]
    assert np.abs(ch.models[-1].prior).min() > 0
    ch.models[-1].prior = np.zeros(3)
    assert ((ch.scores(g, w, len(texts)) > ch.cuts)[:, 0] != whole).any()


@pytest.mark.parametrize("text", ["w_r_e_t_c_h_e_d", "wr3tch3d", "wr*tched", "WRETCHED", "wrеtсhеd", "wretchhhed", "w r e t c h e d", "ｗｒｅｔｃｈｅｄ", "wre​tched", "wrétchéd"])
def test_hidden_spellings(text):
    words = T.Words(frozenset(["wretched", "grumbot"]))
    assert [w for s in words.sentences(T.plain(pa.array([f"you {text} grumbot"]))[0]) for w in s] == ["you", "wretched", "grumbot"]


def test_numbers_are_not_letters():
    assert T.Words().sentences("user12 saw 404 pages, v8 of b12") == [["user9", "saw", "9", "pages", "v9", "of", "b9"]]


def test_score_and_rates(spark):
    rows = corpus(500, 3)
    labels = [(i, k or "OK ", f"r{i % 3}", "x") for i, _, k in rows[:400]] + [(1, None, "r9", "x"), (2, "odd", "r9", "x"), (None, "ok", "r1", "x")]
    docs = [(i, t, "s%d" % (i % 2), 1.0) for i, t, _ in rows] + [(900, None, None, 0.0), (901, "", "s1", 0.0), (902, "word " * 50_000, "s1", 0.0), (903, "!!! ???", "s1", 0.0)]
    d = spark.createDataFrame(docs, "doc long, text string, source string, abusive double").drop("abusive")
    v = spark.createDataFrame(labels + labels[:50], "doc long, label string, reviewer string, text string")
    ch = T.fitted(T.labelled(d, "doc", "text", v, "doc", "label", "reviewer"))
    got = {r.doc: r for r in T.score(d, "doc", "text", ch, "source").collect()}
    assert len(got) == len(docs) and not any(got[k].flagged for k in (900, 901, 902, 903)) and got[900].unacceptable == 0
    assert np.mean([got[i].flagged == (k is not None) for i, _, k in rows[400:]]) > 0.95
    r = {x.source: x for x in T.rates(T.score(d, "doc", "text", ch, "source"), "source").collect()}
    assert r["s0"].documents == 250 and r["s0"].flagged_rate == np.mean([got[i].flagged for i, *_ in rows if i % 2 == 0])
    none = T.fitted(T.labelled(d, "doc", "text", v.limit(0), "doc", "label", "reviewer"))
    assert T.score(d, "doc", "text", none).where("flagged").count() == 0
    assert T.score(d.limit(0), "doc", "text", ch).count() == 0
