"""Plain versions of the operators' contracts, over lists of rows in memory."""

import hashlib
import re
import string
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def op1(docs, tokenizer):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(tokenizer), 0, []
    for i, text in sorted(docs):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def op2(docs, k=13):
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][p : p + k]), i)
    out = []
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < i:
                gone |= set(range(p, p + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def fingerprint(text, k=4):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[p : p + k]).encode(), 42) for p in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def op5(docs, bits=4):
    fps = np.array([fingerprint(t) for _, t in docs], np.uint64)
    ids = np.array([i for i, _ in docs])
    comp = ids.copy()
    while True:
        new = comp.copy()
        for j, f in enumerate(fps):
            hit = np.bitwise_count(fps ^ f) <= bits
            new[j] = comp[hit].min()
        if (new == comp).all():
            break
        comp = new
    return [(int(i), f"{int(f):016x}", int(c)) for i, f, c in zip(ids, fps, comp)]


def op7(docs, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, named = split(t), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if found := windows.get(tuple(w[p : p + k])):
                    named |= found
                    hit |= set(range(p, p + k))
        out.append((i, len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit)))
    return out


def op8(docs, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        rows = (t or "").split("\n")
        kept = [x for x in rows if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(rows), len(rows) - len(kept), sha("\n".join(kept))))
    return out


def op4(vectors, k=10):
    v = {i: np.array(x, float) for i, x in vectors if i is not None and x and None not in x}
    v = {i: x for i, x in v.items() if np.isfinite(x).all() and x.any()}
    out = []
    for q in v:
        if q % 100 == 0:
            near = []
            for c in v:
                if c != q:
                    d = 0.0
                    for a, b in zip(v[q].tolist(), v[c].tolist()):
                        d += (a - b) * (a - b)
                    near.append((d**0.5, c))
            out += [(q, r + 1, c, d) for r, (d, c) in enumerate(sorted(near)[:k])]
    return out
