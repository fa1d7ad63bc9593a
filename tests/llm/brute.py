"""Plain versions of the corpus operators, for small inputs."""
import hashlib
import re
from collections import Counter

SPACES = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeat_words(w, k=5):
    count = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return len({i + j for i in range(len(w) - k + 1) if count[tuple(w[i:i + k])] > 1 for j in range(k)})


def base_failed(text):
    w = space_words(text)
    return len(w) < 10 or 100 * repeat_words(w) > 20 * len(w)


def shingles(text, k=5):
    w = space_words((text or "").translate(UPPER))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def near(docs):
    """{id: component} of {id: text}."""
    sets = {d: shingles(t) for d, t in docs.items()}
    ids = sorted(docs)
    alike = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return components(ids, alike)


def line_form(line):
    return line.strip(" \t\r\x0b\x0c").lower()


def line_shingles(line, k=8):
    return {line[i:i + k] for i in range(max(1, len(line) - k + 1))}


def dedup_lines(docs, like=80):
    """{id: (text, emptied)}: the first line of each component of similar lines stays."""
    lines = sorted({line_form(x) for t in docs.values() for x in (t or "").split("\n")} - {""})
    sets = [line_shingles(x) for x in lines]
    links = []
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if min(len(a), len(b)) * 100 >= like * max(len(a), len(b)) and 100 * len(a & b) >= like * len(a | b):
                links.append((lines[i], lines[j]))
    group, seen, out = components(lines, links), set(), {}
    for d in sorted(docs):
        if docs[d] is None:
            out[d] = (None, False)
            continue
        kept, gone = [], False
        for x in docs[d].split("\n"):
            g = group.get(line_form(x))
            if g is None or g not in seen:
                kept.append(x)
                seen.add(g) if g else None
            else:
                gone = True
        text = "\n".join(kept)
        out[d] = (text, gone and not text.strip(SPACES))
    return out


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def leaks(text, items, k=10):
    """(words, hit words, items) of a text."""
    w = item_words(text)
    windows = {}
    for item, t in items:
        b = item_words(t)
        for i in range(max(1, len(b) - k + 1) if b else 0):
            windows.setdefault(tuple(b[i:i + k]), set()).add(str(item))
    hit, named = set(), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                named |= windows[tuple(w[i:i + n])]
    return len(w), len(hit), sorted(named)


def cut_repeats(texts, width=200):
    """(bytes, removed, spans, sha256 of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if count[d[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out
