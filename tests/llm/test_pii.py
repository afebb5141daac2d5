"""Personal data: base rules against the plain expressions, message passing against enumeration, and what the field adds."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import pii
from quadrille.llm.common import table
from quadrille.llm.queries import op13_pii

RULES = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]
SCHEMA = "doc_id long, text string, found string, key int, _text string"


def plain(text):
    def passes(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == 1:
            return all(int(p) <= 255 for p in m.split("."))
        if kind == 2:
            total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d))))
            return 16 <= len(d) <= 19 and total % 10 == 0
        return kind == 0 or 8 <= len(d) <= 15

    return [(k, *m.span()) for k, rule in enumerate(RULES) for m in re.finditer(rule, text) if passes(k, m[0])]


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


@settings(max_examples=400, deadline=None)
@given(st.text("a9.@+-() 0\n1é", max_size=60))
def test_base_rules_of_any_text(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["x.y@mail1.example.com", "@", ".", "10.2.3.255", "256.1.1.1", "4417744280351547", "4417 7442-8035 1547", "+1 (017) 555-7713", "+", "-", " ", "\n", "7", "é", "a@b", "@c.d"]), max_size=12))
def test_base_rules_of_joined_parts(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain(text)
    g = pii.graph(text)
    for a, b in zip(g.starts, g.ends):
        assert a < b and re.search("[0-9@]", text[a:b]) and not re.search(r"\s", text[a:b])


@pytest.mark.parametrize("part", ["a", "1", "1.", "+1", "@a.", "1 ", "@", "a@", "a.b@c-", "+1(", "1.2.3.4 ", "+1 555 123 4567 ", "x1 ", "9-"])
def test_time_grows_with_the_text(part):
    text = part * (1_000_000 // len(part))
    begun = time.perf_counter()
    pii.base_spans(text)
    assert time.perf_counter() - begun < 3
    g = pii.graph(text)
    assert time.perf_counter() - begun < 40 and len(g.skip) <= 4 * max(1, len(g.starts))


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = op13_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert set(listed(base).split(",")) <= set(r["spans"].split(","))


def model_of(texts):
    graphs, labels, free = zip(*map(pii.example, texts))
    features, chain, skip = pii.joined(list(graphs))
    return pii.train(features, np.concatenate(labels), np.concatenate(free), chain, skip)


def some_texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiounrstl") for _ in range(rng.randrange(2, 8)))
    digit = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))

    def card():
        d = digit(15)
        return next(d + str(x) for x in range(10) if pii.luhn(d + str(x)))

    def mention():
        return rng.choice([f"{word()}.{digit(2)}@mail{digit(1)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), card(), f"+1 ({digit(3)}) 555-{digit(4)}", digit(16), digit(4), f"{word()}{digit(3)}"])

    return [" ".join(mention() if rng.random() < 0.05 else word() for _ in range(120)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return model_of(some_texts(400, 1))


def added(model, text):
    g = pii.graph(text)
    known = pii.given(g, pii.base_spans(text))
    p = pii.beliefs(model, *pii.joined([g]), known)
    return [(pii.KINDS[k], text[a:b]) for k, a, b, _ in pii.added_spans(text, g, p, known)]


FILLER = " some words between them that say nothing at all, " * 30


@pytest.mark.parametrize(
    ("kind", "mention", "again"),
    [
        ("phone", "+1 (017) 555-7713", "(017) 555-7713"),
        ("phone", "+1 (017) 555-7713", "017.555.7713"),
        ("email", "ana.34@mail7.example.com", "ana.34(at)mail7.example.com"),
        ("ip", "129.38.82.176", "129-38-82-176"),
        ("card", "4417744280351547", "4417.7442.8035.1547"),
    ],
)
def test_distant_mentions_agree(model, kind, mention, again):
    """The loose mention is found where the text has the full one, even far away, and only there."""
    found = added(model, f"write to {mention} now{FILLER}or to {again} then")
    assert [k for k, _ in found] == [kind] and re.sub("[^0-9]", "", found[0][1]) == re.sub("[^0-9]", "", again.replace("(017", "017"))
    alone = added(model, f"write to {again} now{FILLER}or then")
    assert alone == [] or kind == "card"  # right check digits tell by themselves


def test_held_out_accuracy(model):
    right = wrong = missed = 0
    for text in some_texts(200, 2):
        g, labels, free = pii.example(text)
        p = pii.beliefs(model, *pii.joined([g]), np.where(free, -1, labels)).argmax(1)[free]
        labels = labels[free]
        right += int(((p == labels) & (labels != pii.NONE)).sum())
        wrong += int(((p != labels) & (p != pii.NONE)).sum())
        missed += int(((p != labels) & (labels != pii.NONE)).sum())
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9


def test_messages_against_enumeration(monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 200)
    rng = np.random.default_rng(0)
    skip = rng.normal(size=(5, 5))
    model = pii.Field(rng.normal(size=(pii.BUCKETS, 5)), rng.normal(size=(5, 5)), skip + skip.T)
    features = np.arange(8).reshape(4, 2)
    for chain, links, close in (([(0, 1), (1, 2)], [(1, 3)], 1e-6), ([(0, 1), (1, 2)], [(0, 3), (2, 3)], 0.25)):
        chain, links = pii._pairs(chain), pii._pairs(links)
        weight = np.zeros((4, 5))
        unary = model.unary[features].sum(1)
        for ys in itertools.product(range(5), repeat=4):
            s = sum(unary[i, y] for i, y in enumerate(ys)) + sum(model.chain[ys[a], ys[b]] for a, b in chain) + sum(model.skip[ys[a], ys[b]] for a, b in links)
            weight[np.arange(4), ys] += np.exp(s)
        exact = weight / weight.sum(1, keepdims=True)
        free = np.full(4, -1)
        assert np.abs(pii.beliefs(model, features, chain, links, free) - exact).max() < close  # a tree is exact, a loop is near
        free[1] = 2
        assert np.abs(pii.beliefs(model, features, chain, links, free)[1, 2] - 1) < 1e-9


def test_defined_cases(spark, model):
    mail, card = "ana.34@mail7.example.com", "4417744280351547"
    texts = [None, "", " ", f"é🙂 {mail}, {card}", f"{card} " * 3000, "word " * 100_000 + mail, mail, mail]
    rows = [(i if i else None, t, "f", 1, "t") for i, t in enumerate(texts)] + [(3, texts[3], "f", 1, "t")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = pii.report(pii.find_pii(docs, model)).collect()
    expected = sorted((str(r[0]), hashlib.sha256(listed(plain(r[1] or "")).encode()).hexdigest()) for r in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == expected
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert clean[None] is None and clean[3] == "é🙂 [EMAIL], [CARD]" and clean[6] == "[EMAIL]" and clean[1] == ""
    assert pii.redact(docs, model).columns == docs.columns
    assert pii.find_pii(docs.limit(0), pii.fit(docs.limit(0))).count() == 0
    nothing = pii.fit(docs.where("doc_id in (1, 2)"))
    assert all(not s["base"] is False for r in pii.find_pii(docs, nothing).collect() for s in r["found"])


def test_overlapping_spans_are_masked_once():
    assert pii.masked("ab cd ef", [(0, 5, 0), (3, 8, 2)]) == "[EMAIL]"
    assert pii.masked("ab cd ef", [(6, 8, 1), (0, 2, 3)]) == "[PHONE] cd [IP]"
