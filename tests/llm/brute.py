"""Plain Python versions of what the operators return, for small tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower):
    text = text or ""
    return WORDS.findall(text.translate(LOWER) if lower else text)


def shingles(text, n=5):
    w = words(text, True)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_duplicates(rows, percent=85):
    """rows: (doc_id, text), ids not null. Set of (doc_id, n_shingles, component)."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        both = len(a & b)
        if a and b and 100 * both >= percent * (len(a) + len(b) - both):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def repeats(rows, n=13):
    """Sorted (doc_id, n_words, n_removed, kept_sha256)."""
    least = {}
    for i, t in rows:
        w = words(t, False)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t, False)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def bigram_scores(rows, folds=10, additive=0.1, discount=0.75):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score) by exact probabilities."""
    tokens = [(i, [*words(t, True), "\n"]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0
    ones, twos = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, w in tokens:
        if not held(i):
            ones.update(w)
            for v, x in zip(["\r", *w], w, strict=False):
                twos[v][x] += 1
    total = sum(ones.values())
    bottom = total + additive * (len(ones) + 1)
    out = []
    for i, w in tokens:
        single = [(ones[x] + additive) / bottom for x in w]
        score = 0.0
        for v, x, p in zip(["\r", *w], w, single, strict=False):
            if twos.get(v):
                seen = sum(twos[v].values())
                p = max(twos[v][x] - discount, 0) / seen + discount * len(twos[v]) / seen * p
            score += math.log10(p)
        out.append((i, held(i), len(w), sum(ones[x] > 0 for x in w), total, sum(map(math.log10, single)), score))
    return out


def ngram_scores(rows, order, folds=10, additive=0.1, discount=0.75):
    """As bigram_scores, with contexts of up to ``order`` - 1 tokens, each level interpolated with the one below."""
    out = bigram_scores(rows, folds, additive, discount)
    tokens = [["\r", *words(t, True), "\n"] for _, t in rows]
    ones, after = collections.Counter(), collections.defaultdict(collections.Counter)
    for w, r in zip(tokens, out, strict=True):
        if not r[1]:
            ones.update(w[1:])
            for p in range(1, len(w)):
                for n in range(1, min(order - 1, p) + 1):
                    after[tuple(w[p - n : p])][w[p]] += 1
    sums = {v: sum(c.values()) for v, c in after.items()}
    bottom = sum(ones.values()) + additive * (len(ones) + 1)
    for k, w in enumerate(tokens):
        score = 0.0
        for at in range(1, len(w)):
            p = (ones[w[at]] + additive) / bottom
            for n in range(1, min(order - 1, at) + 1):
                v = tuple(w[at - n : at])
                if v in after:
                    p = max(after[v][w[at]] - discount, 0) / sums[v] + discount * len(after[v]) / sums[v] * p
            score += math.log10(p)
        out[k] = (*out[k][:6], score)
    return out


ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ALLOW = [r"^[A-Za-z_-]+$", r"^[0-9_-]+$", r"^(?:[A-Za-z_-]*/){2,}[A-Za-z_-]*$", r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
         r"(?i)example|placeholder|changeme|dummy|sample"]


def secrets(text, window=20, hex_bits=2.9, base64_bits=3.7):
    """(counts per base kind, base_sha256, spans)."""
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    counts = [sum(s[1] == k for s in found) for k in range(3)]
    base = hashlib.sha256(join(found).encode()).hexdigest()
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        if any(re.search(p, m[0]) for p in ALLOW):
            continue
        is_hex = bool(re.fullmatch("[0-9A-Fa-f]+", m[0]))
        most = round(window * (math.log2(window) - (hex_bits if is_hex else base64_bits)) * 1e6)
        spans = []
        for p in range(len(m[0]) - window + 1):
            counts_ = collections.Counter(m[0][p : p + window])
            if sum(round(v * math.log2(v) * 1e6) for v in counts_.values()) <= most:
                if spans and spans[-1][1] >= p:
                    spans[-1][1] = p + window
                else:
                    spans.append([p, p + window])
        kind, rank = ("entropy_hex", 3) if is_hex else ("entropy_base64", 4)
        found += [(m.start() + a, rank, m.start() + b, kind) for a, b in spans]
    return (*counts, base, join(found))


def hit_words(text, items, n=10):
    """(n_words, n_hit, item ids) of a document against (item_id, text)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    doc = split(text)
    hit, names = set(), set()
    for item, t in items:
        w = split(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for p in range(len(doc) - size + 1):
                if doc[p : p + size] == w[k : k + size]:
                    hit.update(range(p, p + size))
                    names.add(str(item))
    return len(doc), len(hit), sorted(names)
