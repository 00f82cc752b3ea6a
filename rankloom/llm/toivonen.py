"""Phrase collocation mining by Toivonen's method.

1. A hash-drawn sample of the documents (one in ``SAMPLE``) is counted in full;
   phrases of one to three words seen at least ``LOW`` times there are proposed.
2. One pass over all documents counts the proposals and their negative border:
   phrases that are not proposed while both their longest proper parts are.
   Every word is in the border of the empty phrase, so all words are counted.
   The border is never listed: a phrase is admitted when its parts test positive
   in two bitmaps of proposed words and word pairs. A bitmap may admit a phrase
   too many, which is then counted exactly as well.
3. A word or pair of the border that turns out frequent is a failure: it joins
   the bitmaps, and a further pass counts just the phrases admitted by them now
   and not before. When a pass has no failure the result is closed: all parts of
   a frequent phrase are frequent, so every frequent phrase has been counted.

Counts are per language. In shuffles a word is its 64-bit hash (mixed with the
language), a phrase is up to three of them; texts come back in a last pass, for
the words of the reported phrases only. The bitmaps are bounded
(``BITS_MOST``); beyond it they admit more phrases, and results stay the same.

Defined results: null or empty text has no words; a null language is ``und``;
rows that repeat are counted as often as they occur; ties keep the smallest cut,
and rank by count, then by the phrase's UTF-8 bytes; an empty table gives an
empty result; very long texts are counted whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import common
from rankloom.llm.textops import _TABLE, Rolling, chunks, mix

MIN_COUNT = 10
LONGER_SHARE = 50       # percent of its count that a longer phrase must reach to displace a candidate
TOP = 2000
SAMPLE = 8              # one document in so many is in the sample
LOW = 2                 # count in the sample that proposes a phrase
BITS_EACH = 32          # bits of a bitmap for one proposal
BITS_MOST = 1 << 28     # 32 MB
_PART = 1 << 20         # bits of one part while a bitmap is built
_LETTERS = 1 << 20      # bytes of one run of texts
_HELD = 1 << 19         # words after which equal phrases are merged

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?\n\x0b\x0c\r")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_TERMS = "lang string, h1 long, h2 long, h3 long, a long"


def _salt(lang: str) -> np.uint64:
    b = np.frombuffer(lang.encode() + b"\0", np.uint8)
    return Rolling(_TABLE[b]).slices(np.array([0]), np.array([len(b)]))[0]


class Pieces:
    """Words of a run of texts: hash, language number, and whether the next
    word is in the same piece."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, salts: np.ndarray):
        self.buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        stop = _STOP[self.buf]
        word = ~(_SEP[self.buf] | stop)
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.lang = langs[np.searchsorted(ends, self.start, side="right")]
        h = mix(Rolling(_TABLE[self.buf]).slices(self.start, self.end) + salts[self.lang])
        self.hash = np.where(h == 0, np.uint64(1), h)
        breaks = np.cumsum(stop)
        self.next = np.zeros(len(h), bool)
        if len(h):
            self.next[:-1] = breaks[self.start[1:]] == breaks[self.end[:-1] - 1]

    def text(self, rows: np.ndarray) -> pa.Array:
        return pa.array([self.buf[a:b].tobytes() for a, b in zip(self.start[rows].tolist(), self.end[rows].tolist())],
                        pa.binary()).cast(pa.string())


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[list[str], Pieces]]:
    """Columns ``text, lang`` as runs of pieces of bounded size."""
    texts = common.binaries(batch.column(0))
    codes = batch.column(1).cast(pa.string()).fill_null("und").dictionary_encode()
    names = codes.dictionary.to_pylist()
    number = codes.indices.to_numpy().astype(np.int32)
    salts = np.array([_salt(x) for x in names], np.uint64)
    for i, j in chunks(texts, _LETTERS):
        yield names, Pieces(texts[i:j], number[i:j], salts)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9FB21C651E98DF25) + b)


class Bitmap:
    """Set of 64-bit hashes in a bounded number of bits, without false negatives."""

    def __init__(self, bits: int):
        self.bits = bits
        self.flags = np.zeros(bits >> 3, np.uint8)

    def __contains__(self, _):
        raise TypeError("use has()")

    def slots(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(self.bits - 1)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        s = self.slots(h)
        return (self.flags[s >> 3] >> (s & 7).astype(np.uint8)) & 1 > 0

    @staticmethod
    def size_for(n: int) -> int:
        bits = 1 << 16
        while bits < n * BITS_EACH and bits < BITS_MOST:
            bits *= 2
        return bits

    def joined(self, phrases: DataFrame, pairs: bool) -> Bitmap:
        """This bitmap with the words (or pairs) of the phrases added. Bits are
        gathered in tasks; parts of 128 KB come to the driver."""
        bits = self.bits

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = [b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1)]
                h = pair_hash(h[0], h[1]) if pairs else h[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique((h & np.uint64(bits - 1)).astype(np.int64)))], names=["slot"])

        def part(table: pa.Table) -> pa.Table:
            s = table.column("slot").to_numpy()
            flags = np.zeros(_PART, np.uint8)
            flags[s % _PART] = 1
            return pa.table({"part": pa.array([int(s[0]) // _PART]), "bits": pa.array(
                [np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

        out = Bitmap(bits)
        out.flags = self.flags.copy()
        found = phrases.select("h1", "h2").mapInArrow(slots, "slot long").distinct()
        for r in found.withColumn("part", F.floor(F.col("slot") / _PART)).groupBy("part") \
                .applyInArrow(part, "part long, bits binary").collect():
            a = r["part"] * _PART >> 3
            b = min(len(out.flags), a + (_PART >> 3))
            out.flags[a:b] |= np.frombuffer(r["bits"], np.uint8)[:b - a]
        return out


def _counter(now, before) -> Callable:
    """Count phrases per batch. ``now`` and ``before`` are broadcast pairs of
    bitmaps (words, pairs) or None: admitted now and not before is counted.
    Without ``now`` every phrase is counted; without ``before`` every word and
    each language's number of words are counted too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, old = now and now.value, before and before.value
        for b in batches:
            got, names, held = {1: [], 2: [], 3: []}, [], 0
            for names, p in _runs(b):
                if held > _HELD:
                    yield from grouped(names, got)
                    got, held = {1: [], 2: [], 3: []}, 0
                h, ok2 = p.hash, p.next[:-1]
                held += len(h)
                ok3 = ok2[:-1] & ok2[1:]
                if old is None:
                    got[1].append((p.lang, h))
                if maps is not None:
                    pair = pair_hash(h[:-1], h[1:])
                    w, q = maps[0].has(h), maps[1].has(pair)
                    ok2, ok3 = ok2 & w[:-1] & w[1:], ok3 & q[:-1] & q[1:]
                    if old is not None:
                        w, q = old[0].has(h), old[1].has(pair)
                        ok2, ok3 = ok2 & ~(w[:-1] & w[1:]), ok3 & ~(q[:-1] & q[1:])
                i, j = np.flatnonzero(ok2), np.flatnonzero(ok3)
                got[2].append((p.lang[i], h[i], h[i + 1]))
                got[3].append((p.lang[j], h[j], h[j + 1], h[j + 2]))
            yield from grouped(names, got)

    def grouped(names: list, got: dict) -> Iterator[pa.RecordBatch]:
        for n, parts in got.items():
            if parts:
                yield from _grouped(names, [np.concatenate(x) for x in zip(*parts)], n)
    return run


def _grouped(names: list, cols: list, n: int) -> Iterator[pa.RecordBatch]:
    """Equal phrases of one batch as one row with their count."""
    lang, words = cols[0], cols[1:]
    if not len(lang):
        return
    key = words[0]
    for w in words[1:]:
        key = pair_hash(key, w)
    order = np.argsort(key)
    k = key[order]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    count = np.diff(np.concatenate((head, [len(k)])))
    first = order[head]
    zero = np.zeros(len(first), np.uint64)
    name = pa.array(names, pa.string())
    h = [w[first] for w in words] + [zero] * (3 - n)
    columns = [name.take(pa.array(lang[first])), *map(common.longs, h), pa.array(count)]
    for lo, hi in common.pieces_of(len(first), 1 << 17):
        yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in columns], names=["lang", "h1", "h2", "h3", "a"])
    if n == 1:      # all words of each language, under the empty phrase
        total = np.bincount(lang, minlength=len(names))
        none = pa.array(np.zeros(len(names), np.int64))
        yield pa.RecordBatch.from_arrays([name, none, none, none, pa.array(total)], names=["lang", "h1", "h2", "h3", "a"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)).alias("_s"))


def _counted(docs: DataFrame, now, before, least: int) -> DataFrame:
    out = docs.select("text", "lang").mapInArrow(_counter(now, before), _TERMS)
    return out.groupBy("lang", "h1", "h2", "h3").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("h1") == 0))


_WORD = "h1 != 0 AND h2 = 0"
_PAIR = "h2 != 0 AND h3 = 0"


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, int]:
    """``lang, h1, h2, h3, a`` of every phrase of one to three words with a
    count ``a`` of at least ``min_count`` (unused words are 0; the empty phrase
    has the language's number of words), and the number of full passes."""
    common.prepare(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    texts = _texts(docs)
    proposed = common.materialize(_counted(texts.where("_s = 0"), None, None, min(LOW, min_count)).where("h1 != 0"), "proposed")
    words, pairs = proposed.where(_WORD), proposed.where(_PAIR)
    maps = (Bitmap(Bitmap.size_for(words.count())).joined(words, False),
            Bitmap(Bitmap.size_for(pairs.count())).joined(pairs, True))
    known = proposed.select("h1", "h2", "h3")
    now, before, passes, out = sc.broadcast(maps), None, 0, None
    while True:
        found = common.materialize(_counted(texts, now, before, min_count), "counted")
        passes += 1
        out = found if out is None else out.unionByName(found)
        failed = found.where("h1 != 0 AND h3 = 0")
        if known is not None:       # what the sample did not propose; later passes count only what nobody proposed
            failed = failed.join(known, ["h1", "h2", "h3"], "left_anti")
        failed = common.materialize(failed, "failed")
        kinds = {r["p"] for r in failed.select((F.col("h2") != 0).alias("p")).distinct().collect()}
        if not kinds:
            return out, passes
        maps = (maps[0].joined(failed.where(_WORD), False) if False in kinds else maps[0],
                maps[1].joined(failed.where(_PAIR), True) if True in kinds else maps[1])
        known = None
        before, now = now, sc.broadcast(maps)


def _cut(a: str, left: str, right: str):
    """Score of one cut, exact: counts have 15 digits, products 38."""
    x, y, z = (f"CAST({c} AS DECIMAL(15,0))" for c in (a, left, right))
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7,0)) * ({x} * {x})) DIV ({y} * {z}) AS BIGINT)")


def collocations(frequent: DataFrame, min_count: int = MIN_COUNT, share: int = LONGER_SHARE) -> DataFrame:
    """Candidates of two or three words with their lowest-scoring cut:
    ``lang, h1, h2, h3, a, l, r, score``; those inside a longer candidate that
    is at least ``share`` percent as frequent are left out."""
    word = frequent.where(_WORD).select("h1", "a")
    pair = frequent.where(_PAIR)
    triple = frequent.where("h3 != 0")

    def one(name, count):
        return word.select(F.col("h1").alias(name), F.col("a").alias(count))

    def two(first, second, count):
        return pair.select(F.col("h1").alias(first), F.col("h2").alias(second), F.col("a").alias(count))
    longer = triple.select(F.explode(F.array(
        F.struct("h1", "h2", "a"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))).alias("s")) \
        .groupBy("s.h1", "s.h2").agg(F.max("s.a").alias("most"))
    pairs = pair.join(longer, ["h1", "h2"], "left") \
        .where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))) \
        .join(one("h1", "l"), "h1").join(one("h2", "r"), "h2").withColumn("score", _cut("a", "l", "r"))
    t = triple.join(one("h1", "l1"), "h1").join(two("h2", "h3", "r1"), ["h2", "h3"]) \
        .join(two("h1", "h2", "l2"), ["h1", "h2"]).join(one("h3", "r2"), "h3") \
        .withColumn("s1", _cut("a", "l1", "r1")).withColumn("s2", _cut("a", "l2", "r2"))
    early = F.col("s1") <= F.col("s2")
    triples = t.select("lang", "h1", "h2", "h3", "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                       F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    return pairs.select(triples.columns).unionByName(triples)


def _spell(wanted) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        told: set = set()
        for b in batches:
            for _, p in _runs(b):
                i = np.flatnonzero(bitmap.has(p.hash))
                h, first = np.unique(p.hash[i], return_index=True)
                new = np.array([x not in told for x in h.tolist()], bool)
                if len(told) < 1 << 18:
                    told.update(h[new].tolist())
                yield pa.RecordBatch.from_arrays([common.longs(h[new]), p.text(i[first[new]])], names=["h", "word"])
    return run


def spelled(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """The phrases with their text: words are read back from the documents."""
    h = phrases.select(F.explode(F.array("h1", "h2", "h3")).alias("h")).where("h != 0").distinct()
    wanted = Bitmap(Bitmap.size_for(h.count())).joined(h.select(F.col("h").alias("h1"), F.lit(0).cast("long").alias("h2")), False)
    wanted = docs.sparkSession.sparkContext.broadcast(wanted)
    word = _texts(docs).select("text", "lang").mapInArrow(_spell(wanted), "h long, word string").join(h, "h", "left_semi") \
        .groupBy("h").agg(F.min("word").alias("word"))
    word = common.materialize(word, "words")
    out = phrases
    for c in ("h1", "h2", "h3"):
        out = out.join(word.select(F.col("h").alias(c), F.col("word").alias(f"w{c[1]}")), c, "left")
    return out.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))


def mine(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, share: int = LONGER_SHARE) -> DataFrame:
    """The ``top`` candidates of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    frequent, _ = frequent_phrases(docs, min_count)
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = collocations(frequent, min_count, share).withColumn("_r", F.rank().over(by_score)).where(F.col("_r") <= top).drop("_r")
    best = spelled(docs, common.materialize(best, "best"))
    n = frequent.where("h1 = 0").select(F.col("lang").alias("_lang"), F.col("a").alias("n"))
    best = best.join(n, best["lang"] == n["_lang"])
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_toivonen_phrases(spark, sf_dir: str) -> DataFrame:
    """Collocations of two and three words in the whole ``documents`` table."""
    return mine(common.documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT COALESCE(lang, 'und') AS lang,
                  translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM w WHERE len(w) > 1
      UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM w WHERE len(w) > 2),
f AS MATERIALIZED (SELECT lang, k, phrase, COUNT(*) AS a FROM g GROUP BY ALL HAVING COUNT(*) >= 10),
n AS (SELECT lang, COUNT(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS s, unnest(range(1, k)) AS j FROM f WHERE k > 1),
v AS (SELECT c.*, x.a AS l, y.a AS r,
             ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(s[1:j], ' ')
             JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(s[j + 1:], ' ')),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
u AS (SELECT lang, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS phrase, a
      FROM (SELECT DISTINCT lang, s, a FROM c WHERE k = 3)),
m AS (SELECT lang, phrase, MAX(a) AS most FROM u GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n USING (lang) LEFT JOIN m ON b.k = 2 AND m.lang = b.lang AND m.phrase = b.phrase
WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000
"""
