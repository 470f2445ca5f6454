"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


def fingerprint(text):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words(folded)
    if not w:
        return 0
    n = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest id of each row's group, of (id, fingerprint) pairs."""
    lead = {i: i for i, _ in prints}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, f in prints:
        for b, g in prints:
            if a < b and (f ^ g).bit_count() <= 4:
                x, y = find(a), find(b)
                lead[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def substring(docs):
    first = {}
    for i, text in docs:
        w = words(text)
        for s in range(len(w) - 12):
            g = tuple(w[s : s + 13])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = {p for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < i for p in range(s, s + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def quality_counts(text):
    w = words(text)
    chars = sum(map(len, w))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    full = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeat = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), chars, symbols, len(full) - len(set(full)), len(repeat)


def _long(value, seed):
    return xxhash.xxh64_intdigest((value % 2**64).to_bytes(8, "little"), seed)


def chunks(text, spread=4, reach=2):
    """Chunks of lines: [(first line, lines)]."""
    lines = text.split("\n")
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    starts = [0]
    for i in range(max(1, reach - 1), len(lines)):
        rolled = 42
        for back in range(reach):
            rolled = _long(hashes[i - back], rolled)
        if (rolled if rolled < 2**63 else rolled - 2**64) % spread == 0:
            starts.append(i)
    return [(s, lines[s:e]) for s, e in zip(starts, [*starts[1:], len(lines)], strict=True)]


def line_dedup(docs, spread=4, least=2):
    """Texts of (id, text) pairs of distinct ids without repeated chunks."""
    found, lead = {}, {}
    for i, text in docs:
        if text is None or i is None:
            continue
        found[i] = chunks(text, spread)
        for first, part in found[i]:
            if sum(bool(words(x)) for x in part) >= least:
                key = tuple(part)
                lead[key] = min(lead.get(key, (i, first)), (i, first))
    out = {}
    for i, text in docs:
        if i in found:
            text = "\n".join(x for first, part in found[i] if lead.get(tuple(part), (i, first)) == (i, first) for x in part)
        out[i] = text
    return out


def overlap(text, items, window=13):
    """(words, hit words, item ids) of a text against (id, text) items."""
    fold = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: fold.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, ids = split(text), set(), set()
    for item, body in items:
        b = split(body)
        n = min(window, len(b))
        if not n:
            continue
        grams = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)}
        for s in range(len(w) - n + 1):
            if tuple(w[s : s + n]) in grams:
                hit.update(range(s, s + n))
                ids.add(item)
    return len(w), len(hit), ids
