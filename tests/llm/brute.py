"""Plain counterparts of the corpus operators for small tables."""

import collections
import hashlib
import re

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def roots(nodes, linked):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text):
    words = WORDS.findall(lowered(text))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def contamination(text, items, width=13):
    words, hit, found = BENCH.findall(lowered(text)), set(), set()
    for item, item_text in items:
        iw = BENCH.findall(lowered(item_text))
        n = min(width, len(iw))
        for s in range(len(iw) - n + 1 if iw else 0):
            for i in range(len(words) - n + 1):
                if words[i:i + n] == iw[s:s + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


def without_repeats(texts, length):
    seen = collections.Counter()
    for text in texts:
        data = (text or "").encode()
        seen.update(data[i:i + length] for i in range(len(data) - length + 1))
    out = []
    for text in texts:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if seen[data[i:i + length]] > 1:
                covered[i:i + length] = b"\x01" * length
        kept = bytes(b for b, c in zip(data, covered) if not c)
        out.append((len(data), sum(covered), len(re.findall(b"\x01+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return out


def base_counts(text):
    words = WORDS.findall(text or "")
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeat = {p for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat)


def gone_lines(docs, edit_words=8):
    """{(doc_id, line)} of lines with an earlier equal line or, if long enough, one a word away."""
    lines = [(d, i, tuple(WORDS.findall(lowered(l)))) for d, t in docs for i, l in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < edit_words or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    place = lambda x: (x[0] is None, x[0] or 0, x[1])
    first = {}
    for x in sorted(lines, key=place):
        first.setdefault(x[2], place(x))
    return {(x[0], x[1]) for x in lines if any(f < place(x) and (w == x[2] or f < first[x[2]] and near(w, x[2])) for w, f in first.items())}
