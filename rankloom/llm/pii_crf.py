"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. In documents that have any, the tokens that
carry a digit or an ``@`` (or repeat the name of a found address) become the
nodes of a random field: neighbours in the text share a chain potential, and
tokens that repeat or resemble each other (equal after trimming, equal local
part of an address, equal last seven digits) share a skip potential. Base
spans are evidence. Loopy message passing carries their labels to the other
mentions, e.g. a phone number given again without its country code.

Weights are fitted by pseudo-likelihood on a bounded sample (``SAMPLE_DOCS``
documents of smallest hash among those with base spans), labelled by the
patterns; the features see a token's shape and neighbours. A token is added
only if a skip edge supports its label, its probability reaches
``MIN_PROBABILITY``, and only if such edges lead to a base span, so documents without any base span are left alone.

Spans are code points ``[start, end)``. Defined results: null or empty text
has no spans (`redact` leaves null as it is); repeated rows are alike; an
empty table gives an empty result; extra columns are kept by `redact` and
ignored by `find_spans`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm import common

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 500
MIN_PROBABILITY = 0.9
ROUNDS = 12             # of message passing
SAMPLE_TOKENS = 20000
DECAY = 0.003           # weight decay of the fit

# ---- base patterns ----

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a failed start inside a run of digits fails for the whole run: the look-behind only saves time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from their ``@``: the
    local part is the whole run before it (after the last match)."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of all pattern matches that hold, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


def span_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# ---- the field ----

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = "\"'.,;:!?()[]{}<>"
_LABELS = 1 + len(KINDS)        # 0: none
_FEATURES = 20


class Field:
    """Nodes, features and edges of one document."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        spans = sorted((a, b, k + 1) for k, a, b in base)
        names = {text[a:text.index("@", a)].strip("._%+-").lower() for k, a, _ in base if k == 0}
        names = {n for n in names if len(n) >= 5 and re.search(r"[0-9._]", n)}
        self.start, self.end, self.label, words = [], [], [], []
        order: list[int] = []
        s = 0
        for i, m in enumerate(_TOKEN.finditer(text)):
            word = m[0]
            if not (_DIGIT.search(word) or "@" in word or (names and word.strip(_TRIM).lower() in names)):
                continue
            a, b = m.span()
            while s < len(spans) and spans[s][1] <= a:
                s += 1
            label = 0
            for x, y, k in spans[s:s + 4]:
                if x < b and a < y:
                    label = k
                    break
            trim = _TRIM.replace("()", "") if "(" in word and ")" in word else _TRIM
            lead = len(word) - len(word.lstrip(trim))
            core = word.strip(trim)
            self.start.append(a + lead if core else a)
            self.end.append(a + lead + len(core) if core else b)
            self.label.append(label)
            words.append(word)
            order.append(i)
        self.words, self.order = words, order
        self.n = len(words)
        self.text = text

    def features(self) -> np.ndarray:
        x = np.zeros((self.n, _FEATURES))
        shapes = []
        for w in self.words:
            digits = sum(c in "0123456789" for c in w)
            letters = any(c.isalpha() for c in w)
            shapes.append((1, digits <= 2, 3 <= digits <= 4, 5 <= digits <= 8, 9 <= digits <= 12, digits > 12, letters,
                           "@" in w, "-" in w, "(" in w, w[0] == "+", w.count(".") >= 3, w.strip(_TRIM).count(".") in (1, 2),
                           not letters and digits > 0, "_" in w or "%" in w))
        x[:, :15] = shapes
        for i, j in pairwise(range(self.n)):
            if self.order[j] == self.order[i] + 1:
                x[j, 15] = 1
                x[j, 16] = self.words[i][0] == "+"
                x[j, 17] = "(" in self.words[i]
                x[i, 18] = 1
                x[i, 19] = "(" in self.words[j]
        return x

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Chain and skip edges as pairs of nodes. A repeated form links each
        mention with the one before and with the first: a linear number."""
        chain = [(i, j) for i, j in pairwise(range(self.n)) if self.order[j] == self.order[i] + 1]
        first: dict = {}
        last: dict = {}
        skip = set()
        for i, w in enumerate(self.words):
            core = w.strip(_TRIM).lower()
            digits = re.sub(r"[^0-9]", "", core)
            keys = []
            if len(core) >= 6 and not core.isdigit():
                keys.append(core)
            if "@" in core:
                keys.append(core.split("@")[0].strip("._%+-"))
            elif len(core) >= 5:
                keys.append(core.strip("._%+-"))
            if len(digits) >= 7 and not any(c.isalpha() for c in core):
                keys.append("#" + digits[-7:])
            for key in keys:
                if key in last and last[key] != i:
                    skip.add((last[key], i))
                    if first[key] != last[key]:
                        skip.add((first[key], i))
                first.setdefault(key, i)
                last[key] = i
        both = [np.array(sorted(e), np.int64).reshape(-1, 2) for e in (chain, skip - set(chain))]
        return both[0], both[1]


def fit(fields: list[Field]) -> dict:
    """Weights by pseudo-likelihood: each label given its neighbours' labels."""
    x, y, near, same = [], [], [], []
    seen = 0
    for f in fields:
        if not f.n or seen > SAMPLE_TOKENS:
            continue
        seen += f.n
        label = np.array(f.label)
        hot = np.eye(_LABELS)[label]
        chain, skip = f.edges()
        left, linked = np.zeros((f.n, 2 * _LABELS)), np.zeros((f.n, _LABELS))
        for i, j in chain:
            left[j, :_LABELS] += hot[i]
            left[i, _LABELS:] += hot[j]
        for i, j in skip:
            linked[j] += hot[i]
            linked[i] += hot[j]
        linked[:, 0] = 0
        x.append(f.features())
        y.append(hot)
        near.append(left)
        same.append(np.minimum(linked, 1))
    w, c, s = np.zeros((_FEATURES, _LABELS)), np.zeros((2 * _LABELS, _LABELS)), 2.0
    if x:
        x, y, near, same = map(np.concatenate, (x, y, near, same))
        # once more with the shape hidden: a mention must be explained by its links where its own form says little
        hidden = x * (np.arange(_FEATURES) == 0)
        x, y, near, same = np.concatenate((x, hidden)), np.concatenate((y, y)), np.concatenate((near, near)), np.concatenate((same, same))
        step, n = 2.0, len(x)
        for _ in range(300):
            z = x @ w + near @ c + s * same
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = y - p / p.sum(axis=1, keepdims=True)
            w += step * (x.T @ g / n - DECAY * w)
            c += step * (near.T @ g / n - DECAY * c)
            s = max(s + step * ((same * g).sum() / n - DECAY / 10 * s), 1.0)
    return {"unary": w, "chain": (c[:_LABELS] + c[_LABELS:].T) / 2, "skip": s}


def marginals(f: Field, weights: dict) -> np.ndarray:
    """Label probabilities by loopy sum-product message passing."""
    unary = f.features() @ weights["unary"]
    label = np.array(f.label)
    unary[label > 0] = -30.0            # evidence
    unary[label > 0, label[label > 0]] = 0.0
    chain, skip = f.edges()
    tie = np.zeros((_LABELS, _LABELS))
    np.fill_diagonal(tie[1:, 1:], 2 * weights["skip"])
    src = np.concatenate((chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]))
    dst = np.concatenate((chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]))
    a, b = len(chain), len(skip)
    table = np.concatenate((np.repeat(weights["chain"][None], a, 0), np.repeat(weights["chain"].T[None], a, 0), np.repeat(tie[None], 2 * b, 0)))
    back = np.concatenate((np.arange(a, 2 * a), np.arange(a), np.arange(2 * a + b, 2 * a + 2 * b), np.arange(2 * a, 2 * a + b)))
    msg = np.zeros((len(src), _LABELS))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = (belief[src] - msg[back])[:, :, None] + table
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        done = len(new) == 0 or np.abs(new - msg).max() < 1e-4
        msg = 0.5 * msg + 0.5 * new
        if done:
            break
    belief = unary
    np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], weights: dict) -> list[tuple[int, int, int]]:
    """Spans that the field adds to the base spans of a document."""
    if not base:
        return []
    f = Field(text, base)
    if not f.n or all(f.label):
        return []
    _, skip = f.edges()
    if not len(skip):
        return []
    p = marginals(f, weights)
    best = p.argmax(axis=1)
    # support: linked, over mentions of the same label, with a base span
    support = np.array(f.label) > 0
    grown = True
    while grown:
        grown = False
        for i, j in skip:
            if best[i] and best[i] == best[j] and support[i] != support[j]:
                support[i] = support[j] = grown = True
    own = [best[i] if not f.label[i] and best[i] and p[i, best[i]] >= MIN_PROBABILITY else 0 for i in range(f.n)]
    # a supported token takes along neighbours of its kind, e.g. the parts of a number
    take = [bool(own[i] and support[i]) for i in range(f.n)]
    for order in (range(1, f.n), range(f.n - 2, -1, -1)):
        for i in order:
            j = i - 1 if order.step == 1 else i + 1
            if own[i] and take[j] and own[i] == own[j] and abs(f.order[i] - f.order[j]) == 1:
                take[i] = True
    out: list[list[int]] = []
    for i in range(f.n):
        if not take[i]:
            continue
        if out and i and take[i - 1] and own[i] == own[i - 1] and f.order[i] == f.order[i - 1] + 1:
            out[-1][2] = f.end[i]
        else:
            out.append([int(own[i]) - 1, f.start[i], f.end[i]])
    return [(k, a, b) for k, a, b in out if a < b and not any(a < y and x < b for _, x, y in base)]


# ---- Spark ----

def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of smallest hash with base spans, per task."""
    import heapq
    held: list = []
    for b in batches:
        for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text and (len(held) < SAMPLE_DOCS or -h > held[0][0]) and base_spans(text):
                (heapq.heappush if len(held) < SAMPLE_DOCS else heapq.heappushpop)(held, (-h, text))
    yield pa.RecordBatch.from_arrays([pa.array([-h for h, _ in held], pa.int64()), pa.array([t for _, t in held], pa.string())], names=["h", "text"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """Fit the field on at most ``sample_docs`` documents, each by its nodes
    alone; the driver gets the fitted weights only."""
    text = docs.select(F.col("text").cast("string").alias("text")).where("text rlike '@|[0-9]'")
    rows = text.select(F.xxhash64("text").alias("h"), "text").mapInArrow(_sample, "h long, text string")
    rows = rows.orderBy("h", "text").limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column("text").to_pylist()]
        w = fit([Field(t, base_spans(t)) for t in texts])
        flat = np.concatenate((w["unary"].ravel(), w["chain"].ravel(), [w["skip"]]))
        yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["w"])
    flat = np.array(rows.coalesce(1).mapInArrow(run, "w array<double>").first()["w"])
    cut = _FEATURES * _LABELS
    return {"unary": flat[:cut].reshape(_FEATURES, _LABELS), "chain": flat[cut:-1].reshape(_LABELS, _LABELS), "skip": float(flat[-1])}


def _find(weights: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sha, spans = [], [], []
            for text in b.column(1).to_pylist():
                base = base_spans(text) if text else []
                counts.append([sum(k == i for k, _, _ in base) for i in range(len(KINDS))])
                sha.append(hashlib.sha256(span_text(base).encode()).hexdigest())
                spans.append(span_text(base + added_spans(text, base, weights)) if base else "")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))), pa.array(sha), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return run


def find_spans(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per row: pattern counts, digest of the base spans, and all spans."""
    common.prepare(docs.sparkSession)
    weights = train(docs, sample_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_find(weights), f"doc_id long, {counts}, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the
    one that starts first (then the longest) names the whole stretch."""
    out, done = [], 0
    stretch = None
    for a, b, k in sorted(((a, b, k) for k, a, b in spans), key=lambda s: (s[0], -s[1])):
        if stretch and a < stretch[1]:
            stretch[1] = max(stretch[1], b)
            continue
        if stretch:
            out += [text[done:stretch[0]], f"[{KINDS[stretch[2]].upper()}]"]
            done = stretch[1]
        stretch = [a, b, k]
    if stretch:
        out += [text[done:stretch[0]], f"[{KINDS[stretch[2]].upper()}]"]
        done = stretch[1]
    return "".join(out) + text[done:]


def redact(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with personal data replaced by ``[KIND]``; ``n_chars`` follows
    where there is one, all other columns are unchanged."""
    common.prepare(docs.sparkSession)
    weights = train(docs, sample_docs)

    @F.pandas_udf(T.StringType())
    def clean(texts):
        def one(t):
            base = base_spans(t) if t else []
            return redacted(t, base + added_spans(t, base, weights)) if base else t
        return texts.map(one)
    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out


def op4_pii_crf(spark, sf_dir: str) -> DataFrame:
    """Personal data in the whole ``documents`` table."""
    return find_spans(common.documents(spark, sf_dir))
