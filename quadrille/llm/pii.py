"""Personal data by rules and a skip-chain conditional random field.

Base rules find addresses of mail, numbers of networks, cards and phones. The field adds mentions that the rules miss because
they are written loosely (a phone number without its plus, an address with "(at)"), where the document has the same thing
elsewhere: tokens that repeat or resemble a distant one share a potential with it, neighbours share one too, and loopy
message passing lets the labels of the whole document agree.

* Nodes are the tokens (runs without white space, outer punctuation off) with a digit or an "@"; other words are not labelled.
* Edges: neighbours with one white space between them (a site), and, for each key of a token (its letters and digits, its
  last seven digits, the digits of its site), each occurrence with the next one at another site: as many edges as
  occurrences, whatever the size of a group.
* Labels are the kinds and "none"; features of a token are its shape, lengths, check digits and the word before it. What a
  base rule finds is given: its tokens have that label, and send it along their edges.

Weights are learned by pseudo-likelihood on a sample of at most FIT_DOCUMENTS documents and FIT_TOKENS tokens of each, from
the tokens whose labels are not given. To learn what loose mentions look like, some that the base rules find are written
again, loosely, at the end of the sample's texts, and as many with other digits, which nothing else in the text supports and
which are labelled "none", as are all other tokens.

A span that the field adds passes its kind's check (digits, Luhn, parts) and overlaps no base span. Base spans always stay.

Defined cases: a null text is empty; positions are code points, end exclusive; null and repeated keys pass row by row; equal
rows give equal results; any text is read whole in time linear in its length, and memory for one document's tokens; without
any base span in the sample nothing is added; an empty table gives an empty table; extra columns are not read, and redact()
returns them whatever their names are.
"""

from __future__ import annotations

import pickle
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import WHITE_SPACE, text_or_empty

#: Fixed values of the base rules, in their order.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN_RULE = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP_RULE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD_RULE = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE_RULE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters of the longest card number: 19 digits with a separator between each two.
_LONGEST_CARD = 37

FIT_DOCUMENTS, FIT_TOKENS, LOOSE_MENTIONS = 2000, 400, 8
BUCKETS, STEPS, RATE, PENALTY = 1 << 12, 150, 0.1, 2e-5
ROUNDS, DAMPING = 12, 0.5
#: Characters of texts whose graphs are solved together.
BATCH = 1 << 21

NONE, LABELS = len(KINDS), len(KINDS) + 1
#: Features of a token; log weight of a label that is not the given one.
FEATURES, NEVER = 9, -60.0
Span = tuple[int, int, int]


# Base rules


def _digits(text: str) -> str:
    return re.sub("[^0-9]+", "", text)


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[0::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), by kind and then start. Each rule goes through the text once, in linear time."""
    found: list[Span] = []
    free = before = 0
    for m in _DOMAIN_RULE.finditer(text):
        local = text[max(free, before) : m.start()]
        before = m.start() + 1
        if n := len(local) - len(local.rstrip(_LOCAL)):
            found.append((EMAIL, m.start() - n, m.end()))
            free = m.end()
    found += [(IP, *m.span()) for m in _IP_RULE.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD_RULE.finditer(text):
        if 16 <= m.end() - m.start() <= _LONGEST_CARD and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((CARD, *m.span()))
    found += [(PHONE, *m.span()) for m in _PHONE_RULE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# Tokens and the graph of a document

_FROM = re.compile(r"[0-9@][^\x20\x09-\x0D]*+")
_TRIM = "\"'`()[]{}<>,;:!?.*#%&$|"
_SHAPE = {c: "d" if chr(c).isdigit() else "a" if chr(c).isalpha() else chr(c) for c in range(128)}
_AT = re.compile(r"[\[({<](?:at|dot)[\])}>]", re.I)


@dataclass
class Graph:
    """Tokens of one document (or, joined, of many), their features and edges; a and b of an edge are tokens, a first."""

    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    sites: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: set[tuple[int, int]] = field(default_factory=set)


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def _features(token: str, raw: str, digits: str, before: str) -> list[int]:
    shape = re.sub("[^\x00-\x7f]+", "u", token.translate(_SHAPE))
    short = re.sub("d+", "d", re.sub("a+", "a", shape))
    parts = token.split(".")
    is_ip = len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)
    check = luhn(digits) if 13 <= len(digits) <= 19 else "-"
    own = ("1", f"s{short}", f"l{shape}" if len(shape) <= 24 else f"L{len(shape).bit_length()}", f"n{min(len(digits), 20)}", f"c{check}{len(digits) >= 16}", f"i{is_ip}", f"p{raw[0]}", f"q{token[0] == '+'}{'@' in token}", f"w{before}")
    return [_bucket(f) for f in own]


def graph(text: str) -> Graph:
    g, last, site_tokens, words = Graph(), 0, [], []
    raw_end = -2
    keys: list[list[str]] = []
    numbers: list[str] = []

    def close() -> None:
        whole = "".join(numbers[i] for i in site_tokens)
        if 7 <= len(whole) <= 19:  # no mention has more digits
            for i in site_tokens:
                keys[i] += [f"d{whole}", f"t{whole[-7:]}"]

    for m in _FROM.finditer(text):
        between = text[last : m.start()]
        cut = max(map(between.rfind, WHITE_SPACE)) + 1
        start, end = last + cut, m.end()
        words = between[:cut].rsplit(None, 1)[-1:] or words
        last = end
        raw = text[start:end]
        token = raw.strip(_TRIM)
        if not token:
            continue
        i = len(g.starts)
        lead = len(raw) - len(raw.lstrip(_TRIM))
        g.starts.append(start + lead)
        g.ends.append(start + lead + len(token))
        numbers.append(_digits(token))
        if start - raw_end == 1 and text[raw_end] != "\n":
            g.chain.append((i - 1, i))
            site_tokens.append(i)
        else:
            close()
            site_tokens = [i]
        g.sites.append(site_tokens[0])
        raw_end = end
        plain = re.sub(r"[\W_]+", "", _AT.sub("", token.lower()))
        keys.append([f"k{plain}"] if len(plain) >= 6 else [])
        if len(numbers[i]) >= 7:
            keys[i].append(f"t{numbers[i][-7:]}")
        g.features.append(_features(token, raw, numbers[i], "".join(filter(str.isalpha, words[0].lower())) if words else ""))
    close()
    seen: dict[str, int] = {}
    for i, own in enumerate(keys):
        for key in own:
            j = seen.get(key)
            if j is not None and g.sites[j] != g.sites[i]:
                g.skip.add((j, i))
            seen[key] = i
    return g


# The field


@dataclass(frozen=True)
class Field:
    """unary[bucket, label]; chain[label, label of the next token]; skip[label, label], symmetric."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _pairs(edges) -> np.ndarray:
    return np.array(sorted(edges), np.int64).reshape(-1, 2)


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The rows of `values` added up by their place."""
    return np.stack([np.bincount(at, values[:, c], n) for c in range(values.shape[1])], 1)


def given(g: Graph, spans: list[Span], other: int = -1) -> np.ndarray:
    """The label of each token that a span covers in part or whole; `other` for the rest."""
    labels = np.full(len(g.starts), other)
    starts, ends = np.array(g.starts, np.int64), np.array(g.ends, np.int64)
    for kind, start, end in spans:  # tokens are in order and do not overlap
        labels[np.searchsorted(ends, start, "right") : np.searchsorted(starts, end, "left")] = kind
    return labels


def train(features: np.ndarray, labels: np.ndarray, free: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> Field:
    """Weights by pseudo-likelihood: the label of each token that is `free` (not given), from its features and its
    neighbours' labels. Convex; Adam steps."""
    n = len(labels)
    y = np.eye(LABELS)[labels]
    weights = [np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    flat = features.ravel()
    for step in range(1, STEPS + 1):
        unary, along, across = weights
        logits = unary[features].sum(1)
        for (a, b), w in (((chain[:, 0], chain[:, 1]), along), ((skip[:, 0], skip[:, 1]), across)):
            logits += _sums(b, y[a] @ w, n) + _sums(a, y[b] @ w.T, n)
        p = np.exp(logits - logits.max(1, keepdims=True))
        wrong = (p / p.sum(1, keepdims=True) - y) * free[:, None] / free.sum()
        pair = lambda a, b: y[a].T @ wrong[b] + (y[b].T @ wrong[a]).T
        across_slope = pair(skip[:, 0], skip[:, 1])
        slopes = [_sums(flat, np.repeat(wrong, features.shape[1], 0), BUCKETS), pair(chain[:, 0], chain[:, 1]), (across_slope + across_slope.T) / 2]
        for i, (w, (m, v)) in enumerate(zip(weights, moments, strict=True)):
            slope = slopes[i] + PENALTY * w
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            weights[i] = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Field(*weights)


def beliefs(model: Field, features: np.ndarray, chain: np.ndarray, skip: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Each token's label probabilities, with those of `labels` given (-1: not), by loopy sum-product message passing: all
    messages at once, ROUNDS times, damped."""
    unary = model.unary[features].sum(1)
    known = np.flatnonzero(labels >= 0)
    unary[known] = NEVER
    unary[known, labels[known]] = 0
    n = len(unary)
    if not len(chain) and not len(skip):
        total = unary
    else:
        weights = np.stack([model.chain, model.skip, model.chain.T, model.skip.T])
        kind = np.repeat([0, 1, 2, 3], [len(chain), len(skip)] * 2)
        source, target = np.concatenate([chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]]), np.concatenate([chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0]])
        half = len(source) // 2
        messages = np.zeros((2 * half, LABELS))
        for _ in range(ROUNDS):
            total = unary + _sums(target, messages, n)
            back = np.concatenate([messages[half:], messages[:half]])
            cavity = (total[source] - back)[:, :, None] + weights[kind]
            top = cavity.max(1, keepdims=True)
            sent = top[:, 0] + np.log(np.exp(cavity - top).sum(1))
            messages = DAMPING * messages + (1 - DAMPING) * (sent - sent.max(1, keepdims=True))
        total = unary + _sums(target, messages, n)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def joined(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, chain, skip) of many documents side by side."""
    shifts = np.cumsum([0, *[len(g.starts) for g in graphs]])
    features = np.array([f for g in graphs for f in g.features], np.int64).reshape(-1, FEATURES)
    edges = [np.concatenate([_pairs(getattr(g, kind)) + s for g, s in zip(graphs, shifts, strict=False)] or [_pairs([])]) for kind in ("chain", "skip")]
    return features, *edges


# Learning


def loose(kind: int, mention: str, rng: random.Random) -> str:
    """A mention as the base rules would not find it."""
    d = _digits(mention)
    if kind == EMAIL:
        return re.sub("@", rng.choice(("(at)", "[at]")), mention)
    if kind == IP:
        return mention.replace(".", "-")
    if kind == CARD:
        return rng.choice((".", "/")).join(d[i : i + 4] for i in range(0, len(d), 4))
    return rng.choice((mention.lstrip("+"), re.sub(r"^\+[0-9]+[\x20.-]*", "", mention), f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}"))


def example(text: str) -> tuple[Graph, np.ndarray, np.ndarray]:
    """A document of the sample, with loose mentions written after it, its labels, and whether each is not given."""
    rng, spans = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass"))), base_spans(text)
    written: list[Span] = []
    for kind, start, end in rng.sample(spans, min(LOOSE_MENTIONS, len(spans))):
        word = (text[max(0, start - 40) : start].split() or ["x"])[-1]
        own = loose(kind, text[start:end], rng)
        other = re.sub("[0-9]", lambda _: str(rng.randrange(10)), loose(kind, text[start:end], rng))
        text += f"\n{word} "
        written.append((kind, len(text), len(text) + len(own)))
        text += f"{own}\n{word} {other}\n"
    g = graph(text)
    known, labels = given(g, base_spans(text)), given(g, written, NONE)
    return g, np.where(known >= 0, known, labels), known < 0


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", documents: int = FIT_DOCUMENTS) -> Field:
    """The field, from a sample of at most `documents` rows, drawn by a hash of the key among texts with a digit or an "@"."""
    rows = df.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    share = F.pmod(F.xxhash64("key", F.lit(13)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, documents / max(n, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                g, labels, free = example(x.as_py())
                # The sample's bound on tokens keeps a stretch from the end, where the loose mentions are.
                cut = max(0, len(labels) - FIT_TOKENS)
                edges = [_pairs((a - cut, b - cut) for a, b in e if a >= cut) for e in (g.chain, g.skip)]
                yield pa.record_batch([pa.array([pickle.dumps((np.array(g.features[cut:], np.int64).reshape(-1, FEATURES), labels[cut:], free[cut:], *edges))], pa.binary())], ["example"])

    held = [pickle.loads(r[0]) for r in rows.where(share).select("text").mapInArrow(run, "example binary").limit(documents).collect()]
    held = [x for x in held if len(x[1])]
    if not any(((x[1] != NONE) & x[2]).any() for x in held):
        none = np.zeros((BUCKETS, LABELS))
        none[_bucket("1"), NONE] = 20
        return Field(none, np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    shifts = np.cumsum([0, *[len(x[1]) for x in held]])
    return train(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), *[np.concatenate([x[i] + s for x, s in zip(held, shifts, strict=False)]) for i in (3, 4)])


# Finding


def _passes(kind: int, mention: str) -> bool:
    d = _digits(mention)
    if kind == EMAIL:
        return bool(re.fullmatch(r"[^\s@]+(?:@|[\[({<]at[\])}>])[^\s@]*[A-Za-z][^\s@]*", mention, re.I))
    if kind == IP:
        parts = re.split("[^0-9]+", mention)
        return len(parts) == 4 and all(p and _small(p) for p in parts)
    if kind == CARD:
        return 16 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15 and not re.search("[A-Za-z]", mention)


def added_spans(text: str, g: Graph, p: np.ndarray, known: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, probability): runs of neighbours of one kind that no base span gives and that pass its check."""
    labels, taken = p.argmax(1), known >= 0
    found, i = [], 0
    while i < len(labels):
        j = i + 1
        if labels[i] != NONE and not taken[i]:
            while j < len(labels) and labels[j] == labels[i] and not taken[j] and g.sites[j] == g.sites[i]:
                j += 1
            if _passes(labels[i], text[g.starts[i] : g.ends[j - 1]]):
                found.append((int(labels[i]), g.starts[i], g.ends[j - 1], float(p[i:j, labels[i]].min())))
        i = j
    return sorted(found)


_FOUND = "array<struct<kind: int, start: bigint, end: bigint, score: double, base: boolean>>"


def find_pii(df: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, found) of every row: all spans by kind and start; base spans have score 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(F.col(key), text_or_empty(text).alias("_text"))
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def solve(texts: list[str]) -> list[list[dict]]:
        base, graphs = [base_spans(t) for t in texts], [graph(t) for t in texts]
        known = [given(g, b) for g, b in zip(graphs, base, strict=True)]
        p = beliefs(shared.value, *joined(graphs), np.concatenate(known))
        rows, at = [], 0
        for t, b, g, k in zip(texts, base, graphs, known, strict=True):
            n = len(g.starts)
            spans = [(*x, 1.0, True) for x in b] + [(*x, False) for x in added_spans(t, g, p[at : at + n], k)]
            rows.append([dict(zip(("kind", "start", "end", "score", "base"), x, strict=True)) for x in sorted(spans)])
            at += n
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, size, texts = 0, 0, []
            for i, x in enumerate(batch.column(1)):
                texts.append(x.as_py())
                size += len(texts[-1])
                if size >= BATCH or i + 1 == batch.num_rows:
                    yield pa.record_batch([batch.column(0).slice(lo, len(texts)), pa.array(solve(texts), pa.list_(span))], [key, "found"])
                    lo, size, texts = i + 1, 0, []

    schema = T.StructType([source.schema[key], *T._parse_datatype_string(f"found {_FOUND}").fields])
    return source.mapInArrow(run, schema)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, count of base spans of each kind, base_sha256, spans) of what find_pii() gives."""
    of_kind = lambda i: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == i))).cast("long").alias(f"n_{KINDS[i]}")
    own = F.filter("found", lambda s: s["base"])
    return found.select(key, *map(of_kind, range(len(KINDS))), F.sha2(_listed(own), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (start, end, kind) as [KIND]; of overlapping spans the first, widened over the others."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """df with the personal data in its text masked. Null texts stay null."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for x in batch.column(place):
                t = x.as_py()
                if t:
                    g, base = graph(t), base_spans(t)
                    known = given(g, base)
                    added = added_spans(t, g, beliefs(shared.value, *joined([g]), known), known)
                    t = masked(t, [(a, b, k) for k, a, b, *_ in [*base, *added]])
                clean.append(t)
            yield pa.record_batch([pa.array(clean, batch.schema.types[i]) if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)
