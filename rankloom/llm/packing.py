"""Order-preserving packing of tokenised documents by dynamic programming.

Documents are dealt to ranges of ids and sorted; each range is tokenised (word
by word, with a bounded cache per worker) and packed as a stream in one task.
A sequence may end at a document's or a sentence's end, or inside a sentence
that is longer than ``FORCED_GAP`` tokens. With cut points c and costs p the
best cost to end a sequence at j is

    best[j] = min(best[i] + L - (c[j] - c[i]) for c[j] - c[i] <= L) + p[j]

that is, a sliding-window minimum of best[i] + c[i], kept in a monotone queue:
linear in the number of cut points. Streams are solved in chunks of bounded
length; the last sequence of a chunk goes on into the next.

Defined results: null or empty text is the end token alone; rows that repeat
an id are packed next to each other, ordered by text hash; ids are ordered
null first; very long texts span several sequences; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common
from rankloom.llm.textops import Words, chunks

LENGTH = 2048
END_ID = 1
SENTENCE_COST = 2       # tokens of padding that a cut inside a document is worth
FORCED_COST = 64        # the same for a cut inside a sentence
FORCED_GAP = 256
BLOCK_DOCS = 4096
CHUNK_TOKENS = 1 << 19
CHUNK_BYTES = 2 << 20   # of text tokenised at once
CACHE_WORDS = 1 << 20   # known words of a worker
NEW_WORDS = 1 << 17     # of them, new ones before they are merged
_SEP = "\x1f"           # one token of its own; words that contain it are encoded alone


class _Words:
    """Known words: sorted hashes, and where each word's ids lie in a pool."""

    def __init__(self, keys=None, size=None, pool=None):
        self.keys = np.zeros(0, np.uint64) if keys is None else keys
        self.size = np.zeros(0, np.uint32) if size is None else size
        self.pool = np.zeros(0, np.uint32) if pool is None else pool
        self.at = np.cumsum(self.size, dtype=np.int64) - self.size
        self.used = np.zeros(len(self.keys), bool)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are known, and their places."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return known, at[known]

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.used[at] = True
        size = self.size[at].astype(np.int64)
        return _gather(self.pool, self.at[at], size), size

    def merged(self, other: _Words, used_only: bool) -> _Words:
        """Both, sorted; ``used_only``: without the words that nobody asked for again."""
        mine = np.flatnonzero(self.used) if used_only else np.arange(len(self.keys))
        keys = np.concatenate((self.keys[mine], other.keys))
        order = np.argsort(keys)
        at = np.concatenate((self.at[mine], other.at + len(self.pool)))[order]
        size = np.concatenate((self.size[mine], other.size))[order]
        out = _Words(keys[order], size, _gather(np.concatenate((self.pool, other.pool)), at, size.astype(np.int64)))
        if not used_only:
            out.used = np.concatenate((self.used, other.used))[order]
        return out


def _gather(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    start = np.cumsum(size) - size
    return pool[np.arange(int(size.sum())) + np.repeat(at - start, size)]


class WordEncoder:
    """Token ids of whitespace-separated words. White space ends a word for
    the tokenizer, so a text's ids are its words' ids in a row. Known words are
    found by hash, in a large sorted table and a small one for new words, which is
    merged into it now and then. Beyond ``CACHE_WORDS`` the words that were not
    met again since the last time go, so frequent words stay."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.sep = self.tokenizer.encode(_SEP, add_special_tokens=False).ids
        self.main, self.new = _Words(), _Words()

    def _encode(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if _SEP not in w]
        if len(self.sep) != 1:
            plain = []
        runs = [plain[i:i + 256] for i in range(0, len(plain), 256)]
        texts = [f" {_SEP} ".join(words[i] for i in run) for run in runs]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(ids == self.sep[0])
            if len(cut) != len(run) - 1:      # a word has that token itself
                for i in run:
                    out[i] = self.tokenizer.encode(words[i], add_special_tokens=False).ids
                continue
            for i, part in zip(run, np.split(ids, cut)):
                out[i] = part if i == run[0] else part[1:]
        for i, w in enumerate(words):
            if out[i] is None:
                out[i] = self.tokenizer.encode(w, add_special_tokens=False).ids
        return out

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        key, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        todo = np.arange(len(key))
        parts = []      # places in key, ids, numbers of ids
        for table in (self.main, self.new):
            known, at = table.find(key[todo])
            parts.append((todo[known], *table.ids(at)))
            todo = todo[~known]
        if len(todo):
            buf = words.buf.tobytes()
            s, e = words.start[first[todo]].tolist(), words.end[first[todo]].tolist()
            enc = self._encode([buf[a:b].decode("utf-8", "replace") for a, b in zip(s, e)])
            size = np.fromiter((len(x) for x in enc), np.int64, len(enc))
            flat = np.concatenate([np.asarray(x, np.uint32) for x in enc])
            parts.append((todo, flat, size))
            self.new = self.new.merged(_Words(key[todo], size.astype(np.uint32), flat), False)
            if len(self.new.keys) > NEW_WORDS:
                self.main = self.main.merged(self.new, len(self.main.keys) + len(self.new.keys) > CACHE_WORDS)
                self.new = _Words()
        at, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        base = 0
        for places, flat, n in parts:
            at[places] = base + np.cumsum(n) - n
            size[places] = n
            base += len(flat)
        pool = np.concatenate([flat for _, flat, _ in parts])
        return _gather(pool, at[back], size[back]), size[back]


_ENCODERS: dict = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_lists(enc: WordEncoder, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per text its number, its ids with the end id, and where its sentences end."""
    sentence = np.zeros(256, bool)
    sentence[list(b".!?")] = True
    for i, j in chunks(texts, CHUNK_BYTES):
        w = Words(texts[i:j])
        flat, size = enc.ids(w)
        ends = np.cumsum(size)
        stop = sentence[w.buf[w.end - 1]] if len(w.end) else np.zeros(0, bool)
        for r, (first, last) in enumerate(zip(w.first.tolist(), w.last.tolist())):
            base = int(ends[first - 1]) if first else 0
            top = int(ends[last - 1]) if last > first else base
            yield i + r, np.append(flat[base:top], np.uint32(END_ID)).astype("<u4"), ends[first:last][stop[first:last]] - base


def cut_points(lengths: list[int], sentence_ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a sequence may end, and the cost of each."""
    at, cost, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
    for n, s in zip(lengths, sentence_ends):
        s = s[(s > 0) & (s < n)].astype(np.int64)
        marks = np.concatenate(([0], s, [n]))
        gaps = np.flatnonzero(np.diff(marks) > FORCED_GAP)
        p, c = np.append(s, n), np.append(np.full(len(s), SENTENCE_COST), 0)
        if len(gaps):
            extra = np.concatenate([np.arange(marks[g] + FORCED_GAP, marks[g + 1], FORCED_GAP) for g in gaps])
            p, c = np.append(p, extra), np.append(c, np.full(len(extra), FORCED_COST))
            order = np.argsort(p)
            p, c = p[order], c[order]
        at.append(p + base)
        cost.append(c)
        base += n
    return np.concatenate(at), np.concatenate(cost)


def best_cuts(points: np.ndarray, costs: np.ndarray, length: int, close: bool) -> list[int]:
    """Ends of the sequences of least total padding and cut cost. Unless
    ``close``, the stream goes on: the ends stop where cost is least within
    the last ``length`` tokens."""
    c, p = points.tolist(), costs.tolist()
    n = len(c)
    best, came = [0] * n, [0] * n
    queue = deque([0])      # of increasing best[i] + c[i]
    for j in range(1, n):
        at = c[j]
        while at - c[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        b = best[j] = best[i] + c[i] + length - at + p[j]
        came[j] = i
        v = b + at
        while queue and best[queue[-1]] + c[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not close:
        near = [k for k in range(n) if c[-1] - c[k] <= length and k]
        j = min(near, key=lambda k: (best[k], -k)) if near else n - 1
    out = []
    while j:
        out.append(c[j])
        j = came[j]
    return out[::-1]


class _Stream:
    """Documents of one block, packed in order."""

    def __init__(self, block: int, length: int):
        self.block, self.length, self.sequence = block, length, 0
        self.docs: list = []      # (doc_id, tokens before this part, ids, sentence ends, document tokens)
        self.tokens = 0
        self.rows: list = []

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> None:
        total = len(ids)
        for a in range(0, total, CHUNK_TOKENS):     # a very long document comes in parts
            part = ids[a:a + CHUNK_TOKENS]
            e = ends[(ends > a) & (ends <= a + len(part))].astype(np.int64) - a
            self.docs.append((doc_id, a, part, e, total))
            self.tokens += len(part)
            if self.tokens >= CHUNK_TOKENS:
                self.solve(False)

    def solve(self, close: bool) -> None:
        if not self.docs:
            return
        lengths = [len(d[2]) for d in self.docs]
        points, costs = cut_points(lengths, [d[3] for d in self.docs])
        done = 0
        todo = deque(self.docs)
        for end in best_cuts(points, costs, self.length, close):
            offset, room = 0, end - done
            while room:
                doc_id, start, ids, ends, total = todo[0]
                k = min(room, len(ids))
                self.rows.append((doc_id, start, k, zlib.crc32(ids[:k].tobytes()), total,
                                  (self.block << 24) + self.sequence, offset))
                if k == len(ids):
                    todo.popleft()
                else:
                    todo[0] = (doc_id, start + k, ids[k:], ends[ends > k] - k, total)
                offset += k
                room -= k
            done = end
            self.sequence += 1
        self.docs = list(todo)
        self.tokens -= done


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, length: int) -> Callable:
    names = [x.split()[0] for x in _OUT.split(", ")]

    def batch(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stream = encoder(path), None
        for b in batches:
            texts, ids = common.binaries(b.column("text")), b.column("doc_id").to_pylist()
            if stream is None and texts:
                stream = _Stream(b.column("block")[0].as_py(), length)
            for r, tokens, ends in token_lists(enc, texts):
                stream.add(ids[r], tokens, ends)
                if len(stream.rows) > 20000:
                    yield batch(stream.rows)
                    stream.rows = []
        if stream:
            stream.solve(True)
            yield batch(stream.rows)
    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens.

    Documents are dealt by ranges of id, text hash and (for rows equal in both) row
    number, about ``block_docs`` rows each; each range is one ordered stream, which
    is tokenised and packed in one task."""
    common.prepare(docs.sparkSession)
    order = ["doc_id", "_tk", "_row"]
    rows = common.keyed(docs).withColumn("_row", F.monotonically_increasing_id() % 4096)
    blocks = max(1, -(-docs.select(F.lit(1)).count() // block_docs))
    rows = rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    return rows.select("doc_id", "text", F.spark_partition_id().cast("long").alias("block")).mapInArrow(_pack(tokenizer, length), _OUT)


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op8_pack_documents(spark, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table in sequences of 2048 tokens."""
    return pack(common.documents(spark, sf_dir), tokenizer_path())
