"""Plain single-process versions of the operators' results."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return text.translate(_LOWER)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def chats(rows):
    """rows: (conv_id, turn, role, text)"""
    out = []
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        trained = "".join(t for _, _, r, t in turns if r == "assistant")
        joined = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out.append((conv, len(turns), sha(joined), len(trained), sha(trained)))
    return sorted(out, key=str)


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """sizes: source -> words"""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = total / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        total -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def contamination(docs, items, size=10):
    """docs: (doc_id, text); items: (item_id, text)"""
    windows = defaultdict(set)
    for item, text in items:
        ws = BENCH_WORD.findall(lower(text or ""))
        n = min(size, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            windows[tuple(ws[i : i + n])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        ws = BENCH_WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        names = ",".join(sorted(found))
        out.append((doc, len(ws), len(hit), len(found), sha(names), bool(hit)))
    return sorted(out, key=str)


def base_scores(docs):
    def held(doc):
        return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2

    tokens = [(doc, [*(lower(text or "").encode().split()), None]) for doc, text in docs]
    counts = Counter(t for doc, ts in tokens if not held(doc) for t in ts)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (
            (doc, held(doc), len(ts), sum(counts[t] > 0 for t in ts), n,
             round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 6))
            for doc, ts in tokens
        ),
        key=str,
    )


def repeats(docs, width=200):
    texts = [(doc, (text or "").encode()) for doc, text in docs]
    seen = Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(t), sum(gone), spans, sha(kept)))
    return sorted(out, key=str)


def shingles(text, size=3):
    ws = lower(text or "").encode().split()
    if not ws:
        return frozenset()
    if len(ws) < size:
        return frozenset([tuple(ws)])
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))


def jaccard(docs, percent=90, size=3):
    sets = [(doc, shingles(text, size)) for doc, text in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(i)
    common = Counter()
    for owners in index.values():
        if len(owners) > 1:
            for a in range(len(owners)):
                for b in range(a):
                    common[owners[b], owners[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(sets):
        groups[find(i)].append(doc)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(
        ((doc, len(s), least[find(i)]) for i, (doc, s) in enumerate(sets)), key=str
    )


def line_dedup(docs, min_chars=10):
    def key(line):
        return lower(line.strip(SPACE))

    last = 2**63 - 1
    first = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, last), last if doc is None else doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if len(key(x)) < min_chars or first[key(x)] == (last if doc is None else doc)
        ]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def quality(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        ws = WORD.findall(text)
        windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        seen = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        out.append(
            (doc, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)),
             len(lines) - len(set(lines)), len(repeated),
             len(ws) < 50 or 100 * len(repeated) > 50 * len(ws))
        )
    return sorted(out, key=str)
