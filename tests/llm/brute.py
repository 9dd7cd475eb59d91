"""Plain, slow versions of the text operators."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near(docs, width):
    """{index: (set size, smallest id of the component)} of a list of (id, text)."""
    sets = []
    for _, text in docs:
        w = BLANK.findall(low(text))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 0.7 < len(a) / len(b) < 1.4 and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(len(sets[i]), least.get(find(i))) for i in range(len(docs))]


def windows(docs, width):
    """[(words, removed, sha256 of kept)] of a list of texts."""
    words = [BLANK.findall(t or "") for t in docs]
    seen = collections.Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def phrases(docs, items, window=13):
    """[(words, hit, sorted items)] of a list of texts."""
    known, sizes = collections.defaultdict(set), set()
    for item, text in items:
        w = ALNUM.findall(low(text))
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if w else ():
            known[tuple(w[i : i + k])].add(item)
            sizes.add(k)
    out = []
    for text in docs:
        w, found = ALNUM.findall(low(text)), set()
        hit = [False] * len(w)
        for k in sizes:
            for i in range(len(w) - k + 1):
                own = known.get(tuple(w[i : i + k]))
                if own is not None:
                    found |= own
                    hit[i : i + k] = [True] * k
        out.append((len(w), sum(hit), sorted(str(x) for x in found if x is not None)))
    return out


def quality(text):
    w = BLANK.findall(text or "")
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


ASCII_TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """[(item id, rank, doc id, score)] of lists of (id, text)."""
    held = [(d, collections.Counter(ASCII_TERMS.findall(low(t)))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = collections.Counter(ASCII_TERMS.findall(low(text)))
        scored = []
        for doc, c, n in held:
            m = 100 - 75 + 75 * n * n_docs // length
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return out


def rebuilt(rows):
    """{conversation: [(role, text)]} of (conv_id, turn, role, text), with shared heads."""
    own = collections.defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - int(math.fmod(c, 100)), [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def trie(sequences):
    """Rows of all nodes of {conversation: turns}."""
    members = collections.defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def under(node):
        yield node
        for child in kids[node]:
            yield from under(child)

    out = []
    for node, who in members.items():
        ends = sorted(c for c in who if len(sequences[c]) == len(node))
        below = list(under(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), sum(not kids[x] for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def lines(docs, min_chars=20, min_docs=3):
    """[(id, lines, dropped, text)] of a list of (id, text)."""
    keys = [[low(x.strip(" \t\n\v\f\r")) for x in (t or "").split("\n")] for _, t in docs]
    holders = collections.defaultdict(list)
    for (doc, _), own in zip(docs, keys):
        for key in set(own):
            if len(key) >= min_chars:
                holders[key].append(-1 if doc is None else doc)
    gone = {key: max(who) for key, who in holders.items() if len(who) >= min_docs}
    out = []
    for (doc, text), own in zip(docs, keys):
        drop = [key in gone and (-1 if doc is None else doc) < gone[key] for key in own]
        out.append((doc, len(own), sum(drop), "\n".join(x for x, d in zip((text or "").split("\n"), drop) if not d)))
    return out
