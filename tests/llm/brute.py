"""Plain versions of the operators, for small inputs."""

import collections
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def classes(rows, width, num):
    """{id: (set size, smallest id in reach, linked sets)} of (id, text) rows, Jaccard >= num/100."""
    sets = {i: shingles(t, width) for i, t in rows}
    holders = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    near = collections.defaultdict(set)
    for a, b in {(min(a, b), max(a, b)) for h in holders.values() for a in h for b in h if a != b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
            if sets[a] != sets[b]:
                near[a].add(sets[b])
                near[b].add(sets[a])
    return {i: (len(sets[i]), root(i), len(near[i])) for i in sets}


def lm_scores(rows, weight, codes):
    """{id: (tokens, known, N, base, score)} of (id, text) rows; codes rounds pair counts."""
    words, pairs, texts = collections.Counter(), collections.Counter(), {}
    for i, t in rows:
        w = texts[i] = [*WORD.findall(lower(t)), "\0end"]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            words.update(w)
            pairs.update(zip(["\0start", *w[:-1]], w, strict=True))
    n, v = sum(words.values()), len(words)
    after = {**words, "\0start": words["\0end"]}
    out = {}
    for i, w in texts.items():
        base = score = 0.0
        for c, x in zip(["\0start", *w[:-1]], w, strict=True):
            single = (words[x] + 1) / (n + v + 1)
            base += math.log10(single)
            total = after.get(c, 0)
            pair = min(codes(pairs[c, x]), total)
            score += math.log10(weight * pair / total + (1 - weight) * single if total else single)
        out[i] = (len(w), sum(words[x] > 0 for x in w), n, base, score)
    return out


def runs(words, least, exponent):
    """(start, period, length) of all maximal stretches with smallest period, by comparing words q apart for every q."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, exponent * q) and not any(s <= i and s + m >= i + size for s, _, m in out):
                out.append((i, q, size))
            i = max(j, i + 1)
    return sorted(out)


def planted(doc_id, words):
    """The words of a document with its periodic tail, where it has one."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return list(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def collapsed(words, found):
    gone = {i for s, q, n in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def near_words(counts):
    """{word: (n_near, best near word)} of {word: n}, by comparing all words with all."""

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    met = {w: [v for v in counts if v != w and near(w, v)] for w in counts}
    return {w: (len(m), min(m, key=lambda v: (-counts[v], v), default=None)) for w, m in met.items()}


def variants(counts):
    """{word: (n, n_near, form, form_n, root)} of {word: n}; a form has at least twice the word's n."""
    met = near_words(counts)
    form = {w: best if best is not None and counts[best] >= 2 * counts[w] else None for w, (_, best) in met.items()}
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, met[w][0], form[w], form[w] and counts[form[w]], root)
    return out
