"""Plain versions of the operators, one text at a time, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lower(text or ""))


def leaks(docs, items, size=10):
    """docs {id: text}, items [(id, text)] to {id: (n_words, n_hit, n_items, sha, contaminated)}."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if w:
            for i in range(max(1, len(w) - size + 1)):
                windows[tuple(w[i : i + size])].add(item)
    lengths = sorted({len(w) for w in windows})
    out = {}
    for d, text in docs.items():
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def shingles(text, size=5):
    w = [x for x in BLANK.split(lower(text or "")) if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near(docs, percent=75):
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = defaultdict(int)
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


def pieces(docs, capacity=4096):
    """[(doc_id, piece, start, length, crc)] from the whole text at once."""
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for d, text in docs:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            out.append((d, k // capacity, k, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))))
    return out


def repeats(docs, size=400):
    """[(id, text)] to {position in the list: (n_bytes, n_removed, n_spans, sha of what is kept)}."""
    raw = [(t or "").encode() for _, t in docs]
    count = defaultdict(int)
    for r in raw:
        for i in range(len(r) - size + 1):
            count[hashlib.blake2b(r[i : i + size], digest_size=16).digest()] += 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if count[hashlib.blake2b(r[i : i + size], digest_size=16).digest()] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out
