"""I-Match fingerprints over randomised lexicon subsets.

Terms are words, dealt by hash to ``BUCKETS`` term classes, so that the
lexicon has a fixed size however large the vocabulary grows. One pass counts
the documents of each class (partial counts per task); classes whose inverse
document frequency lies in ``BAND`` make up the lexicon, which is sent to the
tasks as a bitmap of ``BUCKETS`` bits.

A document's terms in the band are sorted and made distinct. Each of
``SUBSETS`` random keys defines nested subsets of the lexicon, of half the
size each; the document is hashed under the smallest of them that holds any of
its terms. So every key contributes a hash of a few terms, for a short as for
a long text. The fingerprint is the row of these hashes; the likeness of two
is the share of keys with equal hashes. A text without terms in the band is
hashed as a whole.

Defined results: null text is empty; documents are ordered by id (null last),
then by text hash, and the one after the last is the first (a lone document's
next is itself); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common
from rankloom.llm.textops import Words, chunks, mix

BUCKETS = 1 << 20
BAND = (4.0, 12.0)      # of ln(documents / documents with the term)
SUBSETS = 32
RANGE_DOCS = 2000       # documents of one id range, about
MAX_RANGES = 10000
_HASH_BITS = 24
_PART = 1 << 15         # term classes of one part of the bitmap


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for b in batches:
        texts = common.binaries(b.column(0))
        for i, j in chunks(texts):
            w = Words(texts[i:j])
            key = w.doc().astype(np.uint64) * np.uint64(BUCKETS) + w.hashes() % np.uint64(BUCKETS)
            counts += np.bincount((np.unique(key) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    for lo, hi in common.pieces_of(len(at), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(at[lo:hi].astype(np.int32)), pa.array(counts[at[lo:hi]])], names=["term", "df"])


def _bitmap(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    flags = np.zeros(_PART, bool)
    flags[table.column("term").to_numpy() - part * _PART] = True
    return pa.table({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})


def lexicon(docs: DataFrame, band=BAND) -> np.ndarray:
    """Which term classes lie in the band: ``BUCKETS`` flags, whatever the
    size of the corpus."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    n = text.count()
    df = text.mapInArrow(_term_counts, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    inside = df.where((idf >= band[0]) & (idf <= band[1])).select((F.col("term") / _PART).cast("int").alias("part"), "term")
    bits = inside.groupBy("part").applyInArrow(_bitmap, "part int, bits binary").collect()     # BUCKETS / 8 bytes in all
    flags = np.zeros(BUCKETS, bool)
    for r in bits:
        flags[r["part"] * _PART:(r["part"] + 1) * _PART] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))
    return flags


_KEYS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def fingerprints(texts: list[bytes], flags: np.ndarray) -> np.ndarray:
    """One row of ``SUBSETS`` hashes per text."""
    out = np.empty((len(texts), SUBSETS), np.uint32)
    for i, j in chunks(texts):
        w = Words(texts[i:j])
        term = (w.hashes() % np.uint64(BUCKETS)).astype(np.int64)
        key = w.doc()[flags[term]] * BUCKETS + term[flags[term]]
        key = np.sort(key)
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        cut = np.searchsorted(key, np.arange(j - i + 1) * BUCKETS)
        term = (key % BUCKETS).astype(np.uint64)
        mixed = mix(term + np.uint64(1))
        for r in range(j - i):
            a, b = int(cut[r]), int(cut[r + 1])
            if a == b:
                digest = np.uint32(int.from_bytes(hashlib.sha256(texts[i + r]).digest()[:8], "big") & 0x7FFFFFFF)
                out[i + r] = (mix(_KEYS ^ np.uint64(digest)) >> np.uint64(64 - _HASH_BITS)).astype(np.uint32)
                continue
            out[i + r] = _subset_hashes(mixed[a:b])
    return out


def _subset_hashes(terms: np.ndarray) -> np.ndarray:
    total = np.zeros(SUBSETS, np.uint64)
    low = np.full(SUBSETS, np.iinfo(np.uint64).max, np.uint64)
    parts = [terms[p:p + 2048] for p in range(0, len(terms), 2048)]
    for t in parts:
        low = np.minimum(low, mix(np.bitwise_xor.outer(_KEYS, t)).min(axis=1))
    # the smallest nested subset with a term: hashes below the next power of two above the minimum
    bound = (np.uint64(1) << (np.floor(np.log2(low.astype(np.float64) + 1)).astype(np.uint64))) - np.uint64(1)
    bound = bound * np.uint64(2) + np.uint64(1)
    for t in parts:
        inside = mix(np.bitwise_xor.outer(_KEYS, t)) <= np.maximum(bound, low)[:, None]
        # a sum of mixed terms hashes the distinct terms as a sorted list would
        total += np.where(inside, t[None, :], np.uint64(0)).sum(axis=1, dtype=np.uint64)
    return (mix(total ^ _KEYS) >> np.uint64(64 - _HASH_BITS)).astype(np.uint32)


def _hex(row: np.ndarray) -> str:
    return row.astype(">u4").tobytes().hex()


def _ranges(bounds: np.ndarray) -> Callable:
    """Deal compressed texts to id ranges; the first document of each range
    also goes to the range before, to be the last one's neighbour there."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids, tk = b.column(0), b.column(1)
            null = np.array(ids.is_null())
            at = ids.fill_null(0).to_numpy()
            last = max(len(bounds) - 1, 0)
            part = np.where(null, last, np.clip(np.searchsorted(bounds, at, side="right") - 1, 0, last))
            first = ~null & np.isin(at, bounds)
            text = pa.array([z.compress(t) for t in common.binaries(b.column(2))], pa.binary())
            extra = np.flatnonzero(first)
            before = np.where(part[extra] == 0, last, part[extra] - 1)
            rows = pa.array(np.concatenate((np.arange(b.num_rows), extra)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((part, before)).astype(np.int32)),
                 pa.array(np.concatenate((null.astype(np.int32), np.full(len(extra), 2, np.int32)))),
                 ids.take(rows), tk.take(rows), text.take(rows)], names=["part", "kind", "doc_id", "_tk", "z"])
    return run


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _compare(flags) -> Callable:
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = np.unpackbits(np.frombuffer(flags.value, np.uint8)).astype(bool)

        def solve(rows: list) -> pa.RecordBatch:
            """All of ``rows`` but the last, which is the last but one's neighbour."""
            own = [r[1] for r in rows]
            texts = [t.decode("utf-8", "replace") for t in own]
            edited = []
            for a, b in zip(texts, texts[1:]):
                half = len(a) // 2
                edited.append((a[:len(a) - half] + b[:half]).encode())
            f, e = fingerprints(own, lex), fingerprints(edited, lex)
            n = len(rows) - 1
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows[:n]], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array([_hex(x) for x in f[:n]]),
                pa.array([_hex(x) for x in e]), pa.array((f[:n] == e).mean(axis=1)), pa.array((f[:n] == f[1:]).mean(axis=1))],
                names=names)

        part, rows, first, ended = None, [], None, False
        for b in batches:
            for lo, hi in common.pieces_of(b.num_rows, 512):
                s = b.slice(lo, hi - lo)
                for p, kind, doc_id, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), s.column(2).to_pylist(), common.unpack(s.column(4))):
                    if p != part:
                        if rows and not ended:      # without a neighbour range: around to its own first
                            yield solve([*rows, first])
                        part, rows, first, ended = p, [], None, False
                    if kind == 2:
                        if rows and not ended:
                            yield solve([*rows, (doc_id, text)])
                        ended = True
                        continue
                    first = first or (doc_id, text)
                    rows.append((doc_id, text))
                    if len(rows) > 256:
                        yield solve(rows)
                        rows = rows[-1:]
        if rows and not ended:
            yield solve([*rows, first])
    return run


def edited_likeness(docs: DataFrame, band=BAND) -> DataFrame:
    """Fingerprints of every document and of its text with the second half
    replaced by the next document's beginning, and their likeness."""
    spark = docs.sparkSession
    common.prepare(spark)
    flags = spark.sparkContext.broadcast(np.packbits(lexicon(docs, band)).tobytes())
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    n = min(MAX_RANGES, max(1, ids.count() // RANGE_DOCS))
    low, cuts = ids.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100000)).first()
    bounds = np.array(sorted({low, *(cuts if n > 1 else [])}) if low is not None else [], np.int64)
    rows = common.keyed(docs).mapInArrow(_ranges(bounds), "part int, kind int, doc_id long, _tk long, z binary")
    rows = rows.repartition("part").sortWithinPartitions("part", "kind", "doc_id", "_tk")
    return rows.mapInArrow(_compare(flags), _OUT)


def op3_imatch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of the whole ``documents`` table and of its edited texts."""
    return edited_likeness(common.documents(spark, sf_dir))
