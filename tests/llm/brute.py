"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}

KINDS = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def secrets(text):
    found = [(m.start(), i, k, m.end()) for i, (k, r, ok) in enumerate(KINDS) for m in r.finditer(text or "") if ok(m)]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
    return (*(sum(f[2] == k for f in found) for k, *_ in KINDS), hashlib.sha256(joined.encode()).hexdigest(), joined)


def lines(docs, least=20, min_docs=3):
    """docs: [(doc_id, text)]; [(doc_id, n_lines, n_dropped, kept)]."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    where = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                where.setdefault(key(x), set()).add(d)
    out = []
    for d, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (len(where.get(key(x), ())) >= min_docs and d < max(where[key(x)]))]
        out.append((d, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(docs, k, num, den):
    """{doc_id: (n, component)} of [(doc_id, text)]."""
    sets = {d: shingle_set(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and den * n >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def grams(text, n):
    w = (text or "").split()
    return set(zip(*(w[i:] for i in range(n))))


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


_TOKEN = regex.compile(r"[\p{L}\p{M}]+|[0-9]+(?:[.,:/][0-9]+)*|[%$€£°]")


def _template(word, units):
    if word[0].isdigit():
        return "<NUM>"
    if word.lower() in units:
        return "<UNIT>"
    return "<NAME>" if regex.match(r"\p{Lu}\p{Ll}", word) else word.lower()


def leaks(docs, items, units, width=8, least=4):
    """{(doc_id, item_id): most windows that match in a row with slots that agree} of [(doc_id, text)] and [(item_id, text)]."""
    kinds = ("<NUM>", "<UNIT>", "<NAME>")
    enough = lambda t: sum(x not in kinds for x in t) >= least
    fold = lambda raw, t: tuple(w.lower() if x == "<NAME>" else x for w, x in zip(raw, t))
    out = {}
    for item, text in items:
        raw = _TOKEN.findall(text or "")
        w = min(width, len(raw))
        if not raw:
            continue
        t = [_template(x, units) for x in raw]
        starts = range(len(raw) - w + 1)
        plain = not any(enough(fold(raw[a : a + w], t[a : a + w])) for a in starts)
        for doc, content in docs:
            own = _TOKEN.findall(content or "")
            o = [_template(x, units) for x in own]
            for shift in range(-len(raw), len(own)):
                ats = []
                for a in starts:
                    b = a + shift
                    if b < 0 or b + w > len(own):
                        continue
                    mine, theirs = (own[b : b + w], o[b : b + w]), (raw[a : a + w], t[a : a + w])
                    if plain:
                        same = [x.lower() for x in mine[0]] == [x.lower() for x in theirs[0]]
                    else:
                        same = enough(theirs[1]) and tuple(mine[1]) == tuple(theirs[1]) or enough(fold(*theirs)) and fold(*mine) == fold(*theirs)
                    if same:
                        ats.append(a)
                if len(ats) < (len(starts) if plain else 1):
                    continue
                best = 0
                for i in range(len(ats)):
                    for j in range(i, len(ats)):
                        places = {p for a in ats[i : j + 1] for p in range(a, a + w) if t[p] in kinds}
                        pairs = {(t[p], raw[p].lower(), own[p + shift].lower()) for p in places}
                        if len({x[:2] for x in pairs}) == len(pairs):
                            best = max(best, j - i + 1)
                if best:
                    out[doc, item] = max(best, out.get((doc, item), 0))
    return out
