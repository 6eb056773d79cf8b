"""Plain versions of the corpus operators, for small inputs: (doc_id, text) pairs in, dictionaries out."""

import hashlib
import itertools
import re

import xxhash
import zstandard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- substring dedup


def substring_dedup(docs, window=20):
    """doc_id -> (words, removed, kept words)."""
    found = {}
    for doc_id, text in sorted(set(docs)):
        w = words(text)
        for i in range(len(w) - window + 1):
            found.setdefault(tuple(w[i : i + window]), []).append((doc_id, i))
    result = {}
    for doc_id, text in set(docs):
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if min(found[tuple(w[i : i + window])]) < (doc_id, i):
                gone.update(range(i, i + window))
        result[doc_id] = (len(w), len(gone), [x for i, x in enumerate(w) if i not in gone])
    return result


def digest(kept):
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()


# --- near dedup


def shingles(text, size):
    w = words(lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def components(docs, size, percent=80):
    """doc_id -> (shingles, smallest id reachable)."""
    sets = {i: shingles(t, size) for i, t in docs}
    label = {i: i for i in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
            if 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((top(a), top(b)))
                label[high] = low
    return {i: (len(s), top(i)) for i, s in sets.items()}


# --- line dedup


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def line_chunks(text, window, divisor, prime):
    """(number, lines) of each chunk."""
    lines = text.split("\n")
    hashes = [_signed(xxhash.xxh64_intdigest(line.encode(), seed=42)) % prime for line in lines]
    chunks, first = [], 0
    for i in range(len(lines)):
        total = 0
        for back in range(window):
            total = total * 31 + (hashes[i - back] if i - back >= 0 else 0)
        rolled = _signed(xxhash.xxh64_intdigest(total.to_bytes(8, "little", signed=True), seed=42))
        if i == len(lines) - 1 or rolled % divisor == 0:
            chunks.append(lines[first : i + 1])
            first = i + 1
    return chunks


def line_dedup(docs, window, divisor, prime):
    """doc_id -> (lines removed, text left)."""
    cut = {i: line_chunks(t, window, divisor, prime) for i, t in docs if t is not None}

    def takes_part(chunk):
        return sum(1 for line in chunk if line.strip(" ")) >= 2

    first = {}
    for i in sorted(cut):
        for k, chunk in enumerate(cut[i]):
            if takes_part(chunk):
                first.setdefault("\n".join(chunk), (i, k))
    result = {}
    for i, chunks in cut.items():
        kept = [c for k, c in enumerate(chunks) if not takes_part(c) or first["\n".join(c)] == (i, k)]
        removed = sum(map(len, chunks)) - sum(map(len, kept))
        result[i] = (removed, "\n".join("\n".join(c) for c in kept))
    return result


def bounded_chunks(text, prime=1_000_000_007):
    every = text.split("\n")
    at = [k for k, line in enumerate(every) if line.strip(" ")]
    hashes = [_signed(xxhash.xxh64_intdigest(every[k].encode(), seed=42)) % prime for k in at]
    sums = [31 * h + b for h, b in zip(hashes, [0, *hashes])]
    rolled = [_signed(xxhash.xxh64_intdigest(t.to_bytes(8, "little", signed=True), seed=42)) for t in sums]
    n, ends, first = len(at), [], 0
    for j in range(n):
        if j == n - 1 or (1 <= j <= n - 3 and rolled[j - 1] > rolled[j] <= rolled[j + 1]):
            while j - first >= 3:
                first += 2
                ends.append(at[first - 1])
            ends.append(at[j])
            first = j + 1
    ends = [*ends[:-1], len(every) - 1]
    return [every[a:b] for a, b in zip([0, *[e + 1 for e in ends]], [e + 1 for e in ends])]


def not_blank(part):
    return [k for k, line in enumerate(part) if line.strip(" ")]


def bounded_line_dedup(docs):
    """doc_id -> (lines removed, text left)."""
    seen, result = set(), {}
    for i, text in sorted({(i, t) for i, t in docs if t is not None}):
        left = []
        for chunk in bounded_chunks(text):
            if len(not_blank(chunk)) < 2 or tuple(chunk) not in seen:
                left.append(chunk)
                seen.add(tuple(chunk))
        result[i] = (text.count("\n") + 1 - sum(map(len, left)), "\n".join("\n".join(c) for c in left))
    return result


# --- quality


def quality(text, rules):
    text = text or ""
    w = words(text)
    size = rules.repeat_window
    windows = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
    repeated = set()
    for i, window in enumerate(windows):
        if windows.count(window) > 1:
            repeated.update(range(i, i + size))
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if words(line):
            duplicates += line in seen
            seen.add(line)
    failed = len(w) < rules.least_words or 100 * len(repeated) > rules.most_repeat_percent * len(w)
    raw = text.encode()
    chunks = [raw[i : i + rules.chunk_bytes] for i in range(0, len(raw), rules.chunk_bytes)]

    def inside(part):
        ratio = len(zstandard.ZstdCompressor(level=rules.level).compress(part)) / len(part) if part else 0.0
        lowest, highest = rules.limits(len(part))
        return lowest <= ratio <= highest

    good = inside(raw) and sum(not inside(c) for c in chunks) <= rules.most_bad_chunks * len(chunks)
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": duplicates,
        "n_repeat_words": len(repeated),
        "base_failed": failed,
        "kept": not failed and good,
    }


# --- packing


def least_padding(histogram, buckets):
    """The least padding over all choices of bucket bounds."""
    sizes = sorted(histogram)
    best = None
    for chosen in itertools.combinations(sizes[:-1], min(buckets, len(sizes)) - 1):
        bounds = [*chosen, sizes[-1]]
        cost = sum(c * (min(b for b in bounds if b >= s) - s) for s, c in histogram.items())
        best = cost if best is None else min(best, cost)
    return best


def packed(docs, bounds, max_tokens, batch_tokens):
    """(doc_id, piece) -> (first word, words, bucket, bucket size, batch, slot)."""
    pieces = []
    for i, text in docs:
        n = len(words(text))
        pieces += [(i, k, at, min(max_tokens, n - at)) for k, at in enumerate(range(0, max(n, 1), max_tokens))]
    result, filled = {}, {}
    for i, k, at, n in sorted(pieces):
        b = next(j for j, bound in enumerate(bounds) if n <= bound)
        rows = max(1, batch_tokens // max(1, bounds[b]))
        place = filled[b] = filled.get(b, -1) + 1
        result[i, k] = (at, n, b, bounds[b], place // rows, place % rows)
    return result
