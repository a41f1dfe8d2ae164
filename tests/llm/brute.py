"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def substring(rows, width=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def suffix(rows, width=50):
    big = 2**63 - 1
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            first[s] = min(first.get(s, big), big if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < (big if i is None else i):
                gone[k : k + width] = b"\1" * width
        out.append((i, len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def contamination(rows, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in set(map(len, windows)):
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    found |= got
                    hit[k : k + n] = [True] * n
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), sum(hit) > 0))
    return out


def longest_matches(rows, items, width=10):
    """(doc_id, text): words, place and item of the longest run of equal words with an item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = {}
    for i, t in rows:
        w, best = words(t), (0, None, True, None)
        for item, text in items:
            v = words(text)
            runs = {}
            for x in range(len(w)):
                for y in range(len(v)):
                    if w[x] == v[y]:
                        runs[x, y] = runs.get((x - 1, y - 1), 0) + 1
                        n = runs[x, y]
                        if n >= min(width, len(v)):
                            best = min(best, (-n, x - n + 1, item is None, item))
        out[i, t] = (-best[0], best[1], best[3])
    return out


def shingles(text, n=5):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_components(rows, percent=75, roots=False):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    if roots:
        return len(groups)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows))]


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(tri)
    covered = {p for k, x in enumerate(tri) if n[x] > 1 for p in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def licences(texts, templates, least):
    """The best cosine of any line, of two or three lines in a row, or of a paragraph, with any template."""
    token = lambda t: re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", t.lower())
    df = Counter(t for x in texts for t in set(token(x)))
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for own in templates.values() for x in own for t in token(x)}
    mean = sum(idf.values()) / len(idf)

    def vector(text):
        v = {t: (1 + math.log(n)) * idf.get(t, mean) for t, n in Counter(token(text)).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    known = [(name, vector(t)) for name, own in templates.items() for t in own]
    out = {}
    for k, text in enumerate(texts):
        clean = [re.sub(r"^[ \t]*(?://+|#+|/?\*+/?|--+|;+|%+|<!--)?[ \t]*|[ \t\r]*(?:\*+/|-->)?[ \t\r]*$", "", x) for x in text.split("\n")]
        lines = [x for x in clean if x]
        said = [" ".join(lines[i : i + n]) for n in (1, 2, 3) for i in range(len(lines) - n + 1)] + re.split("\n{2,}", "\n".join(clean))
        best = max(((round(sum(w * t.get(x, 0) for x, w in v.items()), 9), name) for v in map(vector, filter(token, set(said))) for name, t in known), key=lambda x: (x[0], [-ord(c) for c in x[1]]), default=(0, ""))
        if best[0] >= least:
            out[k] = (best[1], best[0])
    return out
