"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def substring(rows, window):
    docs = [(i, words(t)) for i, t in rows]
    n = Counter(tuple(w[a:a + window]) for _, w in docs for a in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if n[tuple(w[a:a + window])] > 1:
                gone[a:a + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def suffixes(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            x = b[a:a + length]
            if x in seen:
                gone[a:a + length] = b"\1" * length
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size=2):
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def classes(rows, size=2):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def base_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        s = sum((lambda v: (v * 2 - 9 if v > 4 else v * 2) if i % 2 else v)(int(c)) for i, c in enumerate(d[::-1]))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def targets(sizes, weights, cap):
    """Water filling, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, total = sum(sizes.values()) - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > cap * sizes[s]]
        if not over:
            return {s: fixed.get(s, rest * w[s] / total if total else 0.0) for s in order}
        for s in over:
            fixed[s] = cap * sizes[s]


def quality_counts(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    n = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if n[tuple(w[i:i + 8])] > 1:
            hit[i:i + 8] = [True] * 8
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit),
            len(w) < 20 or 100 * sum(hit) > 30 * len(w))


def best_padding(points, costs, length):
    """Least total of padding and cut costs, by trying every predecessor."""
    best = [0] + [float("inf")] * (len(points) - 1)
    for j in range(1, len(points)):
        for i in range(j):
            if points[j] - points[i] <= length:
                best[j] = min(best[j], best[i] + length - (points[j] - points[i]) + costs[j])
    return best[-1]


def by_key(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def collocations(rows, min_count=10, share=50, top=2000):
    """``(lang, rank, phrase, a, l, r, n, score)`` of rows ``(id, text, lang)``."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = defaultdict(list)
    for (lang, *w), a in cand.items():
        if any(100 * b >= share * a and (q[1:3] == tuple(w) or q[2:4] == tuple(w)) for q, b in cand.items()
               if len(q) == 4 and q[0] == lang and len(w) == 2):
            continue
        cuts = [(f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min((1000000 * a * a // (x * y), i, x, y) for i, (x, y) in enumerate(cuts))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, c in out.items()
            for i, (s, a, p, x, y) in enumerate(sorted(c)[:top])]


def best_products(rows, every=20, k=20):
    """``(query_id, rank, vec_id, score)`` of rows ``(id, vector)``."""
    import math
    vecs = []
    for i, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = (i, tuple(math.floor(64 * x) for x in v))
        if q not in vecs:
            vecs.append(q)
    out = []
    for i, q in vecs:
        if i is None or i % every:
            continue
        hits = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0, j) for j, v in vecs if j != i]
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(hits)[:k])]
    return out


def trie(rows, block=20, most=4):
    """Nodes of rows ``(conv_id, turn, role, text)``."""
    import math
    import zlib
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        seq = own.get(c - int(math.fmod(c, block)), [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, d == len(seq)))
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c, e in sorted(m) if e)
        out.append((min(c for c, _ in m), len(p), min(c for c, _ in members[p[:-1]]) if p else None, len(m), kids[p],
                    sum(not kids[q] for q in below),
                    sum((len(members[q]) - 1) * len(words(q[-1][1])) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return out
