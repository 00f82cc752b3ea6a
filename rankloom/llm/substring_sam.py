"""Substring dedup with suffix automata of reference shards.

The corpus is its own reference, so the automata cannot be broadcast whole:
their size grows with the data. Instead the reference is cut into shards of
bounded size by a shared content-defined seed (`passages`), and each shard's
automaton meets just the passages that could match in it. Within a shard every
passage is streamed through the automaton for its matching statistics against
the rest of the shard: at each word the length of the longest suffix that also
occurs at another place. A statistic of at least ``window`` words marks a
maximal span to remove.

Defined results: null or empty text has no words and loses none; texts under
``window`` words lose none; all copies of a passage lose it (ties included);
rows that repeat an id and text are copies of each other; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common, passages

SEED_WORDS = 12
WINDOW = 35


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of hashable symbols, with
    the number of places at which the strings of each state end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.count = [0]

    def add(self, sequence, places: int = 1) -> None:
        """Read a sequence that occurs at so many places."""
        nxt, link, length, count = self.next, self.link, self.len, self.count
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                count[q] += places
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                count.append(places)
                link.append(0)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p == -1:
                    last = cur
                    continue
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            else:
                cur, p = -1, last
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            count.append(0)
            link.append(link[q])
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            if cur == -1:
                last = clone
                count[clone] += places
            else:
                link[cur] = clone
                last = cur

    def close(self, places: int) -> None:
        """Count places up the suffix links; keep, per state, the length of
        its longest suffix that has at least ``places``."""
        order = sorted(range(1, len(self.next)), key=self.len.__getitem__, reverse=True)
        for v in order:
            self.count[self.link[v]] += self.count[v]
        best = self.best = [0] * len(self.next)
        for v in reversed(order):
            best[v] = self.len[v] if self.count[v] >= places else best[self.link[v]]

    def statistics(self, sequence) -> list[int]:
        """Matching statistics of a sequence: per position the length of the
        longest suffix read so far that has enough places in the shard."""
        nxt, link, length, best = self.next, self.link, self.len, self.best
        v = size = 0
        out = []
        for c in sequence:
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
            b = best[v]
            out.append(b if b < size else size)
        return out


def _solve(window: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        """Windows of one shard's distinct passages that occur at two places or
        more, copies of a passage being places of their own."""
        table = table.combine_chunks()
        bodies = table.column("body").to_pylist()
        locs = table.column("loc").to_pylist()
        sam = SuffixAutomaton()
        ids: dict[bytes, int] = {}
        coded = [[ids.setdefault(w, len(ids)) for w in b.split()] for b in bodies]
        for words, copies in zip(coded, table.column("copies").to_pylist()):
            sam.add(words, copies)
        sam.close(2)
        rows, out = [], []
        for r, words in enumerate(coded):
            first = locs[r] // passages._LOC
            run_start = -1
            for i, m in enumerate([*sam.statistics(words)[window - 1:], 0]):
                if m >= window:
                    run_start = i if run_start < 0 else run_start
                elif run_start >= 0:
                    rows.append(r)
                    out.append((first + run_start) * passages._LOC + i - run_start)
                    run_start = -1
        at = pa.array(rows, pa.int64())
        return pa.table({"seed": table.column("seed").take(at), "piece": table.column("piece").take(at),
                         "loc": pa.array(out, pa.int64()), "hot": table.column("hot").take(at)})
    return run


def removal_runs(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """Runs of windows that start at two places or more: ``doc_id, _tk, loc``."""
    k = min(seed_words, window)
    occ = passages.repeated_pieces(docs, "word", k, window)
    distinct = passages.distinct_pieces(occ)
    shard, parts, first = passages.shards(docs, distinct.where("multi or copies > 1"), "word", window, k)
    found = common.materialize(shard.groupBy("shard").applyInArrow(
        _solve(window), "seed long, piece long, loc long, hot boolean"), "found")
    # the verdict on a part is that on all that equal it
    unit = passages._LOC
    hot = found.where("hot").select(F.col("seed").alias("key"), F.col("piece").alias("same"), F.col("loc").alias("_found")) \
        .join(first.select("key", "same", F.col("loc").alias("_at")), ["key", "same"])
    hot = parts.join(hot, ["key", "same"]).select("seed", "piece", (
        F.col("_found") + (F.floor(F.col("loc") / unit) - F.floor(F.col("_at") / unit)) * unit).cast("long").alias("loc"))
    runs = found.where("not hot").select("seed", "piece", "loc").unionByName(hot)
    runs = runs.join(distinct.select("seed", "piece", F.col("rep.loc").alias("_first")), ["seed", "piece"])
    runs = common.materialize(runs.select("seed", "piece", F.col("loc").alias("_run"), "_first"), "runs")
    # a run lies as far from the start of every copy of its passage as from the first one's
    moved = F.col("_run") + (F.floor(F.col("loc") / unit) - F.floor(F.col("_first") / unit)) * unit
    return occ.join(runs, ["seed", "piece"]).select("doc_id", "_tk", moved.cast("long").alias("loc"))


def _apply(window: int, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in common.pieces_of(b.num_rows, 256):
                part = b.slice(lo, hi - lo)
                n_words, n_removed, sha, kept, spans = [], [], [], [], []
                for text, locs in zip(common.unpack(part.column(1)), part.column(2).to_pylist()):
                    words = text.split()
                    gone = passages.covered(len(words), locs, window)
                    if locs:
                        words_kept = np.array(words, object)[~gone].tolist()
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                        spans.append([{"start": a, "end": z} for a, z in edge.reshape(-1, 2).tolist()])
                    else:
                        words_kept = words
                        spans.append([])
                    rest = b" ".join(words_kept)
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(words_kept))
                    sha.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                cols = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
                if with_text:
                    cols.append(pa.array([k.decode("utf-8", "replace") for k in kept]))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS,
                     with_text: bool = True) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that also starts
    at another place of the corpus. Per document row: counts, the SHA-256 of
    the kept words, the removed maximal word spans, and (``with_text``) the
    kept text."""
    common.prepare(docs.sparkSession)
    runs = passages.spans_by_document(removal_runs(docs, window, seed_words))
    texts = common.packed(docs)
    both = texts.join(runs, common.same_key(texts, runs), "left").select(texts["doc_id"], "z", "locs")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return both.mapInArrow(_apply(window, with_text), schema + (", kept string" if with_text else ""))


def op1_substring_sam(spark, sf_dir: str) -> DataFrame:
    """Substring dedup of the whole ``documents`` table, 35 words."""
    out = dedup_substrings(common.documents(spark, sf_dir), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


#: windows by digest, the runs of repeated ones as islands, and what lies between the islands
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest([md5(array_to_string(w[i + 1:i + 35], ' ')) FOR i IN range(0, len(w) - 34)]) AS h,
             unnest(range(0, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
hit AS (SELECT doc_id, i FROM x JOIN (SELECT h FROM x GROUP BY h HAVING COUNT(*) > 1) USING (h)),
cut AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 35 THEN 1 ELSE 0 END AS c FROM hit),
grp AS (SELECT *, SUM(c) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut),
isl AS (SELECT doc_id, MIN(i) AS s, MAX(i) + 35 AS e FROM grp GROUP BY doc_id, g),
gap AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM isl),
kept AS (SELECT doc_id, flatten(list(w[p + 1:s] ORDER BY s)) AS head, MAX(e) AS tail, SUM(e - s)::BIGINT AS n_removed, COUNT(*) AS n_spans
         FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_removed, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN tail IS NULL THEN w ELSE list_concat(head, w[tail + 1:len(w)]) END, ' ')) AS kept_sha256,
       COALESCE(n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN kept USING (doc_id)
"""
