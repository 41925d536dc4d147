"""Plain versions of the contracts, a document at a time, to test the operators against."""

import hashlib


def removed(docs, n=13):
    """{doc_id: (n_words, n_removed, sha256)} of docs, a dict of texts."""
    first, words = {}, {d: (t or "").encode().split() for d, t in docs.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), d)
    out = {}
    for d, ws in words.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - n + 1):
            if first[tuple(ws[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        kept = b" ".join(w for w, g in zip(ws, gone) if not g)
        out[d] = (len(ws), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def simhash(docs, distance=2):
    """{doc_id: (fingerprint, component_id)}."""
    import xxhash

    prints = {}
    for d, t in docs.items():
        ws = (t or "").encode().lower().split()
        shingles = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [b" ".join(ws)] if ws else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {f: f for f in prints.values()}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    all_prints = list(root)
    for i, a in enumerate(all_prints):
        for b in all_prints[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints.items():
        r = find(f)
        least[r] = min(least.get(r, d), d)
    return {d: (f"{f:016x}", least[find(f)]) for d, f in prints.items()}


def rules(docs):
    """{doc_id: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)}."""
    import re
    from collections import Counter

    out = {}
    for d, t in docs.items():
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        inside = set()
        for i in range(len(ws) - 2):
            if grams[tuple(ws[i : i + 3])] > 1:
                inside |= {i, i + 1, i + 2}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        out[d] = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), len(ws) < 50 or 100 * len(inside) > 50 * len(ws))
    return out


def hits(docs, items, n=13):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}; items: (item_id, text)."""
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))

    tests = {}
    for i, t in items:
        ws = words(t)
        m = min(n, len(ws))
        for a in range(len(ws) - m + 1 if m else 0):
            tests.setdefault(tuple(ws[a : a + m]), set()).add(str(i))
    lengths = {len(k) for k in tests}
    out = {}
    for d, t in docs.items():
        ws = words(t)
        hit, found = set(), set()
        for m in lengths:
            for a in range(len(ws) - m + 1):
                if (w := tuple(ws[a : a + m])) in tests:
                    hit |= set(range(a, a + m))
                    found |= tests[w]
        out[d] = (len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws))
    return out


def base_scores(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    import math
    import zlib
    from collections import Counter

    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t in docs.items()}
    apart = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    c = Counter(w for d, ws in tokens.items() if not apart[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (apart[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens.items()}


def context(text, i, order):
    """How many of the bytes before place i are missing, and the others."""
    return max(0, order - i), text[max(0, i - order) : i]


def cell(text, i):
    """Which path the symbol at place i has: by the byte before and by itself, 256 for none and the end."""
    return (text[i - 1] if i else 256) * 257 + (text[i] if i < len(text) else 256)


def contexts(corpus, tree, orders):
    """How often each bit came at each node of the tree in each context: {(predictor, context, node, bit): n}."""
    from collections import Counter

    told = Counter()
    for text in corpus:
        for i in range(len(text) + 1):
            at = cell(text, i)
            for k, order in enumerate(orders):
                for j in range(tree.lens[at]):
                    told[k, context(text, i, order), tree.inner[j, at], tree.bits[j, at]] += 1
    return told


def mixed(text, tree, told, start, of):
    """log2 of the chance of a text and its end; `of` has the constants."""
    import math

    weights = [[float(w) for w in row] for row in start]
    refined = [(b + 0.5) / of.BUCKETS for b in range(of.BUCKETS)]
    total = 0.0
    for a in range(0, len(text) + 1, of.STRIDE):
        moves, bits, seen = [[0.0] * len(of.ORDERS) for _ in range(of.GATES)], [0] * of.GATES, [[0, 0] for _ in range(of.BUCKETS)]
        for i in range(a, min(a + of.STRIDE, len(text) + 1)):
            at = cell(text, i)
            for j in range(tree.lens[at]):
                gate, bit = min(j, of.GATES - 1), int(tree.bits[j, at])
                given = []
                for k, order in enumerate(of.ORDERS):
                    zero, one = (told[k, context(text, i, order), tree.inner[j, at], b] for b in (0, 1))
                    given.append(max(-127, min(127, round(math.log((one + 0.4) / (zero + 0.4)) * of.STEP))))
                fine = max(0, min(2 * of.LIMIT * of.FINE, int(sum(w * g for w, g in zip(weights[gate], given, strict=True)) / of.STEP * of.FINE + of.LIMIT * of.FINE + 0.5)))
                chance = 1 / (1 + math.exp(-(fine / of.FINE - of.LIMIT)))
                bucket = min(int(chance * of.BUCKETS), of.BUCKETS - 1)
                final = 0.75 * chance + 0.25 * refined[bucket]
                total += math.log2(final if bit else 1 - final)
                bits[gate] += 1
                seen[bucket][bit] += 1
                for k, g in enumerate(given):
                    moves[gate][k] += (bit - chance) * g
        for gate in range(of.GATES):
            for k in range(len(of.ORDERS)):
                weights[gate][k] += min(of.RATE, 0.5 / max(bits[gate], 1)) / of.STEP * moves[gate][k]
        for b, (zero, one) in enumerate(seen):
            refined[b] += (one - (zero + one) * refined[b]) / (zero + one + of.LAG)
    return total


def periodic(words, least=24, times=3):
    """(start, length, period) of the runs of a list, by comparing all words at each distance."""
    import numpy as np

    number = {}
    w, out = np.array([number.setdefault(x, len(number)) for x in words], np.int64), set()
    for q in range(1, len(w) // times + 1):
        apart = np.concatenate([[-1], np.flatnonzero(w[:-q] != w[q:]), [len(w) - q]])
        sizes = np.diff(apart) - 1 + q
        for k in np.flatnonzero(sizes >= max(least, times * q, q + 1)):
            said = w[apart[k] + 1 : apart[k] + 1 + sizes[k]]
            if not any((said[:-r] == said[r:]).all() for r in range(1, q)):
                out.add((int(apart[k]) + 1, int(sizes[k]), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_summary(doc_id, text):
    """The row of a document after its doc_id, with the contract's repeats put in."""
    import zlib
    from fractions import Fraction

    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = periodic(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    most = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *((*most, 1000 * most[1] // most[2]) if most else (None,) * 4), hashlib.sha256("".join(f"{s},{z},{q}\n" for s, z, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
