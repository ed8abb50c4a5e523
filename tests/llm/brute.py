"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None, size: int = 2) -> set:
    w = WORD.findall(fold(text or ""))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def near_dup(rows: list[tuple[int, str | None]], size: int = 2, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id to (size of its set, component); doc_ids are distinct. Links between all pairs, by an inverted index."""
    sets = {d: shingles(t, size) for d, t in rows}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    parent = {d: d for d in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in where[x] if e < d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def targets(sizes: dict, weights=(5, 2, 1), volume=1.5, cap=2) -> dict:
    """source to target, by rounds."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = volume * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > cap * sizes[s]}
        if not above:
            return {s: float(cap * sizes[s]) if s in full else share[s] for s in order}
        full |= above


def repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, sha256 of what stays) of each text."""
    import hashlib

    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def has_run(doc: str | None, items: list[str], n: int = 13) -> bool:
    """Whether n words in a row of an item, or half of its words, stand in the document, letter case and edges aside."""

    def core(text):
        out = [re.sub(r"^[^a-z0-9\x80-\U0010ffff]+|[^a-z0-9\x80-\U0010ffff]+$", "", w) for w in WORD.findall(fold(text or ""))]
        return [w for w in out if w]

    words = core(doc)
    grams = {k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} for k in {n, 5, 6, 7, 8}}
    for item in items:
        w = core(item)
        if len(w) >= 8 and any(tuple(w[i : i + n]) in grams[n] for i in range(len(w) - n + 1)):
            return True
        size = min(8, len(w))
        hit = {j for i in range(len(w) - size + 1) if size >= 5 and tuple(w[i : i + size]) in grams[size] for j in range(i, i + size)}
        if hit and 2 * len(hit) >= len(w):
            return True
    return False


def template(text: str | None, units: set[str]) -> list[tuple[str, object, int, int]]:
    """(token, slot value or None, first word, word after) of a text's template, and words are those with a letter or digit."""
    raw = WORD.findall(text or "")
    out, opens, number_before, n = [], 1, False, 0
    for k, w in enumerate(raw):
        if k == 0 or raw[k - 1][-1] in ".!?:":
            opens = 3  # passes over two marks that stand alone
        core = re.sub(r"^[^A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff]+$", "", w)
        if not core:
            opens = max(0, opens - 1)
            continue
        low = fold(core)
        if core[0] in "0123456789":
            token = "<number>"
        elif number_before and low in units:
            token = "<unit>"
        elif core[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and not opens:
            token = "<name>"
        else:
            token = low
        if token == "<name>" and out and out[-1][0] == "<name>":
            out[-1] = (token, out[-1][1] + (low,), out[-1][2], n + 1)
        else:
            out.append((token, None if token == low else (low,), n, n + 1))
        number_before, opens, n = token == "<number>", 0, n + 1
    return out


def decontaminate(doc: str | None, items: list[str], units: set[str], window=8, least=5, plain=0.6) -> tuple[int, float]:
    """(longest run, largest share of an item) by comparing every diagonal; each item's template is its own."""

    def consistent(pairs):
        return len({*pairs}) == len({a for a, _ in pairs}) == len({b for _, b in pairs})

    best_run, best_share = 0, 0.0
    kinds = [template(doc, units), [(w, None, k, k + 1) for k, w in enumerate(_core_words(doc))]]
    for item in items:
        own = [template(item, units), [(w, None, k, k + 1) for k, w in enumerate(_core_words(item))]]
        matched = [set(), set()]
        for kind in (0, 1):
            a, b = own[kind], kinds[kind]
            size = min(window, len(a))
            if size < least:
                continue
            for shift in range(-len(a), len(b)):
                covered = set()
                for i in range(len(a) - size + 1):
                    if 0 <= i + shift and i + shift + size <= len(b):
                        x, y = a[i : i + size], b[i + shift : i + shift + size]
                        if all(p[0] == q[0] for p, q in zip(x, y, strict=True)) and sum(p[1] is None for p in x) >= plain * size:
                            covered |= set(range(i, i + size))
                for i in sorted(covered):
                    if i - 1 in covered:
                        continue
                    j = i
                    while j in covered:
                        j += 1
                    pieces = [(q - p, -p, p, q) for p in range(i, j) for q in range(p + 1, j + 1) if consistent([(a[k][1], b[k + shift][1]) for k in range(p, q) if a[k][1] is not None])]
                    n, _, p, q = max(pieces)
                    if n >= size:
                        best_run = max(best_run, n)
                        matched[1] |= set(range(a[p][2], a[q - 1][3]))
                        if kind == 0:
                            matched[0] |= set(range(p, q))
        best_share = max([best_share, *(len(m) / len(o) for m, o in zip(matched, own, strict=True) if o)])
    return best_run, best_share


def _core_words(text: str | None) -> list[str]:
    out = [re.sub(r"^[^a-z0-9\x80-\U0010ffff]+|[^a-z0-9\x80-\U0010ffff]+$", "", w) for w in WORD.findall(fold(text or ""))]
    return [w for w in out if w]


def colliding_words(letters: str = "ab", n: int = 1024) -> tuple[str, str]:
    """Two words that any polynomial hash modulo 2**64 takes for one: the Thue-Morse word and its complement."""
    bits = [k.bit_count() % 2 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)
