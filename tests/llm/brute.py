"""Plain versions of the text operators, for small inputs."""

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\r\x0b\x0c"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def fingerprint(text):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """Component number of each fingerprint."""
    label = list(range(len(prints)))
    points = np.array(prints, dtype=np.uint64)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= radius) + i + 1:
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def similar_components(texts, similarity=0.8):
    """Component number of each text, linked by the Jaccard similarity of five-word shingles."""
    sets = [set(shingle_bag(ascii_lower(t or "").split(), 5)) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if len(a & sets[j]) >= similarity * len(a | sets[j]) and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def line_key(line):
    return ascii_lower(line.strip(SPACES))


def kept_lines(docs, min_chars=20, min_docs=3):
    """Number of dropped lines and kept text of each ``(doc_id, text)``."""
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(doc_id)
    last = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if last.get(line_key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines) - len(stay), "\n".join(stay)))
    return out


def shingle_bag(words, k=5):
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def benchmark_hits(text, items, similarity=0.8):
    """Best similarity of each item that reaches it."""
    words, found = WORD.findall((text or "").lower()), {}
    for item_id, item in items:
        own = WORD.findall((item or "").lower())
        if not own:
            continue
        k = min(5, len(own))
        bag, all_of = shingle_bag(own, k), shingle_bag(words, k)
        for start in range(max(1, len(all_of) - len(bag) + 1)):
            window = all_of[start : start + len(bag)]
            both = sum((Counter(window) & Counter(bag)).values())
            value = both / (len(window) + len(bag) - both)
            if value >= similarity:
                found[item_id] = max(found.get(item_id, 0), value)
    return found


def statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words))


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def personal_spans(text):
    """Pattern spans as written in a result."""
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def subsequence_kernel(a, b, span=6, decay=0.5):
    """Gap-weighted kernel of three-character subsequences by their definition."""

    def features(word):
        out = Counter()
        for i in range(len(word)):
            for k in range(i + 2, min(len(word), i + span)):
                for j in range(i + 1, k):
                    out[word[i], word[j], word[k]] += decay ** (k - i - 2)
        return out

    x, y = features(a), features(b)
    return sum(v * y[k] for k, v in x.items())


def water_fill(sizes, weights=(5, 2, 1)):
    """Targets of the sources ``{name: size}`` by sharing again until none is above twice its size."""
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    rest, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = rest / sum(weight[n] for n in open_)
        full = {n for n in open_ if share * weight[n] > 2 * sizes[n]}
        if not full:
            out |= {n: share * weight[n] for n in open_}
            break
        for n in full:
            out[n] = 2.0 * sizes[n]
            rest -= out[n]
        open_ -= full
    return out
