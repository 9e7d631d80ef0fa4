"""Plain versions of what the operators must return, over Python lists."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACE = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text: str | None):
    spans = []
    for k, (kind, p) in enumerate(PII.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                spans.append((m.start(), k, m.end()))
    spans.sort()
    joined = ",".join(f"{list(PII)[k]}:{a}:{b}" for a, k, b in spans)
    return [sum(s[1] == k for s in spans) for k in range(4)], sha(joined), joined


def licenses(text: str | None):
    words = ALNUM.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def held(template: list, words: list) -> float:
    """The largest share of a template's words in a run of at most its length divided by 0.8."""
    width = -(-len(template) * 10 // 8)
    return max((len(set(words[i : i + width]) & set(template)) / len(set(template)) for i in range(max(1, len(words) - width + 1))), default=0)


def contaminated(texts: list, items: list):
    """[(n_words, n_hit, n_items, items_sha256)] of texts against (item_id, text) pairs."""
    index = defaultdict(set)
    for i, t in items:
        w = tuple(ALNUM.findall((t or "").translate(LOWER)))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            index[w[s : s + n]].add("" if i is None else str(i))
    lengths = {len(k) for k in index}
    out = []
    for t in texts:
        w = tuple(ALNUM.findall((t or "").translate(LOWER)))
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if w[s : s + n] in index:
                    hit.update(range(s, s + n))
                    found |= index[w[s : s + n]]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found)))))
    return out


def shingle_set(text: str | None, size: int = 3):
    w = SPACE.findall((text or "").translate(LOWER))
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def union_find(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def jaccard_components(docs: list, size: int = 3, num: int = 90):
    """{doc_id: (set size, component)} of (doc_id, text) pairs."""
    sets = {d: shingle_set(t, size) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    edges = set()
    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for e in by[x]:
                if e < d:
                    common[e] += 1
        edges |= {(e, d) for e, n in common.items() if 100 * n >= num * (len(s) + len(sets[e]) - n)}
    root = union_find(sets, edges)
    return {d: (len(s), root[d]) for d, s in sets.items()}


def conversation(rows: list):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of (turn, role, text) rows of one conversation."""
    low = lambda x: (x is not None, x)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, low(r[1]), low(r[2])))
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    return len(rows), sha("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)), len(loss), sha(loss)
