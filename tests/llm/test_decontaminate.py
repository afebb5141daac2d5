"""Lightly edited benchmark items are found wherever the words were replaced."""

import random
import re
from itertools import combinations
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import decontaminate as d

SCHEMA = "doc_id long, text string, text_id string, item_id string, place string, _own_0 string"


def bloom_of(hashes, n_bits=1 << 16):
    bits = np.zeros(n_bits // 8, np.uint8)
    for h in hashes:
        for k in range(d.PROBES):
            at = (int(h) >> 12 * k) & (n_bits - 1)
            bits[at >> 3] |= 1 << (at & 7)
    return d.Bloom(bits)


def overlaps(items, texts):
    """{(text, item): (first, end, equal words)} by the operator's own steps, with a dictionary for the join."""
    table = {}
    for i, words in enumerate(items):
        for _, places, around, hashes in d.item_windows(words) if len(words) else ():
            for place, row, own in zip(places.tolist(), around, hashes, strict=True):
                for h in own.tolist():
                    table.setdefault(h, []).append((i, place, row, len(words)))
    found = {}
    for seed in {d.seed_of(len(w)) for w in items if len(w)}:
        for owners, places, around, hashes in d.found_windows(texts, seed, bloom_of(table)):
            for owner, at, row, own in zip(owners.tolist(), places.tolist(), around, hashes, strict=True):
                for i, place, other, n in {(x[0], x[1]): x for h in own.tolist() for x in table.get(h, ())}.values():
                    if len(other) == len(row):
                        ok, equal, first, last = d.verify(row[None], other[None], np.array([n]))
                        if ok[0]:
                            lo = at - d.REACH
                            span = (lo + int(first[0]), lo + int(last[0]) + 1, int(equal[0]))
                            found[owner, i] = max(found.get((owner, i), span), span, key=lambda x: (x[1] - x[0], x[2]))
    return found


def brute(item, text):
    """Whether some alignment has a window with enough equal words."""
    n = min(len(item), 20)
    for shift in range(-len(item), len(text)):
        equal = [0 <= i + shift < len(text) and text[i + shift] == w for i, w in enumerate(item)]
        if any(sum(equal[a : a + n]) >= ceil(0.8 * n) for a in range(len(item) - n + 1)):
            return True
    return False


def words(*of):
    return d.word_hashes([" ".join(of)])[0]


def edited(item, changed):
    out = item.copy()
    out[list(changed)] = [1000 + i for i in range(len(changed))]
    return out


@pytest.mark.parametrize("n", [*range(1, 23), 26])
def test_all_single_and_double_substitutions(n):
    item = words(*[f"w{i}" for i in range(n)])
    span = min(n, 20)
    texts, kept = [], []
    for changed in [(), *combinations(range(n), 1), *combinations(range(n), min(n, 2))]:
        equal = np.ones(n, int)
        equal[list(changed)] = 0
        wanted = max(equal[lo : lo + span].sum() for lo in range(n - span + 1)) >= ceil(0.8 * span)
        for before, after in ((["a", "b"] * 9, ["c"]), ([], [])):
            texts.append(np.concatenate([words(*before), edited(item, changed), words(*after)]))
            kept.append(wanted)
    assert {t for t, _ in overlaps([item], texts)} == {t for t, k in enumerate(kept) if k}


@pytest.mark.parametrize("n,most", [(14, 2), (15, 3), (19, 3), (20, 4)])
def test_all_substitutions_that_leave_four_fifths(n, most):
    item = words(*[f"w{i}" for i in range(n)])
    own = words("a", *[f"w{i}" for i in range(n)], "b")
    texts = [edited(own, [c + 1 for c in changed]) for changed in combinations(range(n), most)]
    found = overlaps([item], texts)
    assert len(found) == len(texts)
    assert all(1 <= first < end <= n + 1 and equal == n - most for first, end, equal in found.values())
    beyond = [edited(own, [c + 1 for c in changed]) for changed in combinations(range(0, n, 2), most + 2)]
    assert not overlaps([item], beyond)


def test_ends_beyond_the_document_count_as_replaced():
    five = [f"w{i}" for i in range(5)]
    twenty = [f"v{i}" for i in range(20)]
    items = [words(*five), words(*twenty)]
    texts = [words(*five[1:]), words(*five[:4]), words(*five[:3]), words(), words("x", *five[1:4], "y"), words(*twenty[4:]), words(*twenty[:16]), words(*twenty[5:]), words(*twenty[2:18])]
    assert {k: v[:2] for k, v in overlaps(items, texts).items()} == {(0, 0): (0, 4), (1, 0): (0, 4), (5, 1): (0, 16), (6, 1): (0, 16), (8, 1): (0, 16)}


def test_residues_and_repeated_words():
    item = [f"w{i}" for i in range(50)]
    items = [words(*item), words(*["spam"] * 40), words("spam", "spam")]
    # Every fifth word is replaced: each window has replaced words of every residue but one of 5.
    texts = [words("a", *[w if i % 5 else "x" for i, w in enumerate(item)], "b"), words(*["spam"] * 5000), words("x", "spam", "x", "spam")]
    found = overlaps(items, texts)
    assert set(found) == {(0, 0), (1, 1), (1, 2)} and found[1, 1][2] == 20
    # A repeated word gives as many rows as it has different surroundings.
    seed, rows = d.seed_of(40), 0
    for owners, *_ in d.found_windows([texts[1]], seed, bloom_of({int(h) for *_, hs in d.item_windows(items[1]) for own in hs for h in own})):
        rows += len(owners)
    assert rows < 40


def test_random_texts_against_brute_force():
    rng = random.Random(5)
    items = [words(*rng.choices("abcdefgh", k=n)) for n in (3, 4, 6, 9, 11, 15, 18, 22, 30)]
    texts = []
    for _ in range(150):
        own = items[rng.randrange(len(items))].copy()
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = rng.randrange(1, 1000)
        lo = rng.choice([0, 0, 1, 2])
        texts.append(np.concatenate([words(*rng.choices("abcdefghijklmnop", k=rng.randrange(8))), own[lo:], words(*rng.choices("abcxyz", k=rng.randrange(8)))]))
    want = {(t, i) for t, text in enumerate(texts) for i, item in enumerate(items) if brute(item.tolist(), text.tolist())}
    assert 60 < len(want) and set(overlaps(items, texts)) == want


def test_long_texts_in_slices(monkeypatch):
    item = [f"w{i}" for i in range(30)]
    text = [*[f"x{i}" for i in range(500)], *item, *[f"y{i}" for i in range(500)]]
    whole = overlaps([words(*item)], [words(*text), words(*item)])
    monkeypatch.setattr(d, "SLICE", 7)
    monkeypatch.setattr(d, "HELD", 3)
    monkeypatch.setattr(d, "CHARACTERS", 5)
    d._tables.cache_clear()
    assert overlaps([words(*item)], [words(*text), words(*item)]) == whole
    monkeypatch.undo()
    d._tables.cache_clear()
    assert whole == {(0, 0): (500, 530, 20), (1, 0): (0, 30, 20)}


def test_word_hashes(monkeypatch):
    texts = ["", "one", "One two_three  four's", "naïve ÉTÉ 漢字x ½ ²", "a" * 50 + " b", "x\x00y\ny", " ", "ΟΔΟΣ οδος", "a" * 12]
    own = [[m.lower() for m in re.findall(r"[^\W_]+", t.lower())] for t in texts]
    for characters in (1 << 19, 3, 1, 7):
        monkeypatch.setattr(d, "CHARACTERS", characters)
        d._tables.cache_clear()
        found = d.word_hashes(texts)
        assert [len(f) for f in found] == [len(w) for w in own]
        hashes = {}
        for f, ws in zip(found, own, strict=True):
            for h, w in zip(f.tolist(), ws, strict=True):
                assert hashes.setdefault(w, h) == h
        assert len(set(hashes.values())) == len(hashes)
    monkeypatch.undo()
    d._tables.cache_clear()


def frame(spark, texts, keys=None):
    keys = range(len(texts)) if keys is None else keys
    return spark.createDataFrame([(k, t, "x", "y", "z", "o") for k, t in zip(keys, texts, strict=True)], SCHEMA)


def test_the_whole_job(spark, monkeypatch):
    passage = [f"word{i}" for i in range(40)]
    swapped = [w if i % 11 else "other" for i, w in enumerate(passage)]
    texts = [
        "intro " + " ".join(passage) + " outro", "x " + " ".join(swapped).upper() + "!", " ".join(passage[:15]), "six short words are right here", None, "", "nothing in common " * 30,
        " ".join(passage[5:30]), "six short swapped are right here", "a tiny item", "intro " + " ".join(passage) + " outro",
    ]
    rows = [(1, " ".join(passage)), (2, "six short words are right here"), (3, "tiny item"), (4, None), (None, "tiny item"), (5, " !")]
    items = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "item_id long, text string, n_words string, h string")
    keys = [0, 1, 2, 3, 4, 5, 6, 7, 8, None, 0]
    for hashes in (1 << 22, 100):
        monkeypatch.setattr(d, "PART_HASHES", hashes)
        found = d.contaminated(frame(spark, texts, keys), items).collect()
        assert sorted([(r.doc_id, r.item_id) for r in found], key=str) == sorted([(0, 1), (0, 1), (1, 1), (3, 2), (7, 1), (8, 2), (None, 3), (None, None)], key=str)
        first = next(r for r in found if r.doc_id == 0)
        assert (first.first_word, first.end_word, first.n_matched) == (1, 41, 20)
    clean = d.decontaminate(frame(spark, texts), items)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 4, 5, 6] and clean.columns == frame(spark, []).columns
    assert d.contaminated(frame(spark, texts), items.limit(0)).count() == 0
    assert d.contaminated(frame(spark, []), items).count() == 0
    assert d.decontaminate(frame(spark, texts), items.limit(0)).count() == len(texts)


def test_the_filter_holds_every_hash(spark):
    hashes = [int(x) for x in np.random.default_rng(1).integers(-(2**63), 2**63, 3000)]
    bloom = d._bloom(spark.createDataFrame([(h,) for h in hashes], "h long"))
    assert len(bloom.places(np.array(hashes).view(np.uint64))) == 3000
    others = np.random.default_rng(2).integers(0, 2**63, 200_000).astype(np.uint64)
    assert len(bloom.places(others)) < 200
    assert len(d._bloom(spark.createDataFrame([], "h long")).places(others)) == 0


def test_hot_passages_keep_every_row(spark):
    passage = " ".join(f"w{i}" for i in range(120))
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{passage} tail"), (F.col("id") % 30).cast("string")).alias("text"))
    items = spark.createDataFrame([(i, f"{passage} {i}") for i in range(20)], "item_id long, text string")  # a phrase that many items share
    assert d.contaminated(df, items).count() == 60 * 20 and d.decontaminate(df, items).count() == 0
    compared = d.matches(df, items, "text")[0].count()
    assert compared < 20_000 < 30 * 20 * 111  # pairs of surroundings, not of all windows of texts and items
