"""Plain Python versions of the operators, and the awkward table that all are tried on."""

import itertools
import math
import re
import unicodedata
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    out = []
    for ch in (text or "").lower():
        out.append(ch if unicodedata.category(ch)[0] in "LMN" else " ")
    return "".join(out).split()


def gram_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard_pairs(docs, n, t):
    sets = {i: gram_set(x, n) for i, x in docs.items()}
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= t - 1e-12:
                out[a, b] = j
    return out


def longest_match(doc, item):
    """(length, place in doc, place in item) of the longest common run of words, the first of equals."""
    d, q = words(doc), words(item)
    best = (0, 0, 0)
    for i in range(len(d)):
        for j in range(len(q)):
            k = 0
            while i + k < len(d) and j + k < len(q) and d[i + k] == q[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i, j)
    return best


def word_list(n, seed=1):
    import random

    r = random.Random(seed)
    return [f"{r.choice('bcdfghjklm')}{r.choice('aeiou')}{r.choice('nprst')}{r.choice('aeiou')}{r.randrange(30)}" for _ in range(n)]


def awkward():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    base = " ".join(word_list(60)) + ". " + " ".join(word_list(40, 2)) + "."
    near = base.replace(base.split()[30], "changed")
    long = " ".join(word_list(120_000, 3))
    return [
        (1, base, "en", "a", 10),
        (2, base, "en", "b", 10),
        (2, base, "en", "b", 10),
        (3, near, "en", None, None),
        (4, None, "en", "a", 0),
        (5, "", None, "a", 0),
        (6, "   \n ... !!", "de", "b", 9),
        (7, long, "fr", "a", len(long)),
        (None, base, "en", "a", 10),
        (None, None, None, None, None),
        (8, "one", "", "c", 3),
        (9, "one", "es", "c", 3),
        (10, "Ünïcödé ßtraße ñandú 日本語 tests", "de", "c", 30),
        (10, "another text under the same id", "en", "c", 30),
    ]


def clashing(df):
    """The same with extra columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["block", "bucket", "norm", "rule", "rule_no", "shard", "mix_copies", "mix_rate", "mix_words", "mix_source", "keep", "quality", "n_words", "grams", "lang_found", "count", "row", "link"]
    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in names))


def trigram_lm(texts, target, weights, v):
    """log P of texts[target] with its own counts deleted; `weights` is the table by bucket."""
    end = object()
    uni, bi, tri = Counter(), Counter(), Counter()
    for k, t in enumerate(texts):
        w = words(t)
        if k == target or not w:
            continue
        w = [*w, end]
        uni.update(w)
        bi.update(zip(w, w[1:]))
        tri.update(zip(w, w[1:], w[2:]))
    n = sum(uni.values())
    w = [*words(texts[target]), end]
    total = 0.0
    for i, x in enumerate(w):
        c2 = uni[w[i - 1]] if i >= 1 else 0
        c3 = bi[w[i - 2], w[i - 1]] if i >= 2 else 0
        p = [tri[w[i - 2], w[i - 1], x] / c3 if c3 else 0, bi[w[i - 1], x] / c2 if c2 else 0, uni[x] / n, 1 / (v + 1)]
        b = 128 + int(math.log2(c3)) if c3 else 64 + int(math.log2(c2)) if c2 else 0
        total += math.log(sum(a * l for a, l in zip(p, weights[b])))
    return total


class TrigramCounts:
    """Counts of all texts, from which `score` takes away a text's own."""

    def __init__(self, texts):
        self.uni, self.bi, self.tri = Counter(), Counter(), Counter()
        for t in texts:
            self._add(t, 1)

    def _add(self, text, by):
        w = words(text)
        w = [*w, None] if w else []
        for x in w:
            self.uni[x] += by
        for x in zip(w, w[1:]):
            self.bi[x] += by
        for x in zip(w, w[1:], w[2:]):
            self.tri[x] += by

    def score(self, text, weights, v):
        self._add(text, -1)
        n, w, total = sum(self.uni.values()), [*words(text), None], 0.0
        for i, x in enumerate(w if len(w) > 1 else []):
            c2 = self.uni[w[i - 1]] if i >= 1 else 0
            c3 = self.bi[w[i - 2], w[i - 1]] if i >= 2 else 0
            p = [self.tri[w[i - 2], w[i - 1], x] / c3 if c3 else 0, self.bi[w[i - 1], x] / c2 if c2 else 0, self.uni[x] / n, 1 / (v + 1)]
            total += math.log(sum(a * l for a, l in zip(p, weights[128 + int(math.log2(c3)) if c3 else 64 + int(math.log2(c2)) if c2 else 0])))
        self._add(text, 1)
        return total


def lm_weights(texts, held, rounds=60):
    """Mixture weights by bucket: EM on the very estimates of held-out events under counts of all other texts; and the probabilities they give each event."""
    end = object()
    uni, bi, tri = Counter(), Counter(), Counter()
    for k, t in enumerate(texts):
        w = words(t)
        if k in held or not w:
            continue
        w = [*w, end]
        uni.update(w)
        bi.update(zip(w, w[1:]))
        tri.update(zip(w, w[1:], w[2:]))
    n, v = sum(uni.values()), len(uni)
    seen = {}
    for k in held:
        w = words(texts[k])
        for i, x in enumerate([*w, end] if w else []):
            c2 = uni[w[i - 1]] if i >= 1 else 0
            c3 = bi[w[i - 2], w[i - 1]] if i >= 2 else 0
            p = [tri[w[i - 2], w[i - 1], x] / c3 if c3 else 0, bi[w[i - 1], x] / c2 if c2 else 0, uni[x] / n, 1 / (v + 1)]
            seen.setdefault(128 + int(math.log2(c3)) if c3 else 64 + int(math.log2(c2)) if c2 else 0, []).append(p)
    out = {}
    for b, rows in seen.items():
        usable = [any(r[k] > 0 for r in rows) for k in range(4)]
        lam = [u / sum(usable) for u in usable]
        for _ in range(rounds):
            new = [0.0] * 4
            for r in rows:
                whole = sum(a * l for a, l in zip(r, lam))
                for k in range(4):
                    new[k] += r[k] * lam[k] / whole / len(rows)
            close, lam = max(abs(a - l) for a, l in zip(new, lam)) < 1e-6, new
            if close:
                break
        out[b] = lam
    return out, seen


def split_url(url):
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)", url or "")
    if not m:
        return "", []
    return m[1].lower().rstrip("."), [x for x in m[2].split("/") if x]


def url_action(url, allow, block):
    host, path = split_url(url)
    best = (0, "none", None)
    for action, entries in (("allow", allow), ("block", block)):
        for e in entries:
            h, p = split_url("http://" + e)
            hit = host == h if p else host == h or host.endswith("." + h)
            depth = len(h.split(".")) + len(p)
            if hit and path[: len(p)] == p and (depth > best[0] or depth == best[0] and action == "block"):
                best = (depth, action, e)
    return best[1:]


def mixture(rows, temperature):
    """Rates of rows (source, text) by bisection, a source at a time, with the smallest total that takes no words from any."""
    size = [len((t or "").split()) for _, t in rows]
    have = Counter()
    for (s, _), n in zip(rows, size):
        have[s] += n
    unit = sum(size) / len(rows)
    share = {s: w**temperature for s, w in have.items() if w}
    whole = sum(share.values())
    total = max(have[s] * whole / w for s, w in share.items())
    lam = {}
    for s, w in share.items():
        own = [n for (x, _), n in zip(rows, size) if x == s]
        lo, hi = 0.0, 1.0
        words_at = lambda a: sum(n * math.exp(a * n / unit) for n in own)  # noqa: B023, E731
        while words_at(hi) < total * w / whole:
            hi *= 2
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if words_at(mid) < total * w / whole else (lo, mid)
        lam[s] = lo
    return [math.exp(lam[s] * n / unit) if s in lam else 1.0 for (s, _), n in zip(rows, size)], size


def rule_features(text):
    """The statistics that quality rules use, in plain Python."""
    t = text or ""
    chars, kind = max(1, len(t)), [unicodedata.category(c) for c in t]
    space = [c in " \t\n\x0b\f\r" for c in t]
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
    lines = [x for x in (y.strip(" ") for y in t.split("\n")) if x]
    n = max(1, len(w))
    return {
        "n_words": len(w), "word_length": sum(not s for s in space) / n, "letter_share": sum(k[0] == "L" for k in kind) / chars, "upper_share": sum(k == "Lu" for k in kind) / chars,
        "digit_share": sum(k == "Nd" for k in kind) / chars, "symbol_share": sum(k[0] not in "LMN" and not s for k, s in zip(kind, space)) / chars, "distinct_word_share": len(set(w)) / n,
        "repeated_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)), "sentence_ends": sum(c in ".!?" for c in t) / n, "lines_per_word": len(lines) / n,
    }


def matches(docs, items, least):
    """Longest common runs of words of at least `least`, or of a whole shorter item, by a table of the items' n-grams: {(doc, item): (length, place in doc, place in item)}."""
    split = {i: words(t) for i, t in items.items()}
    table = {}
    for i, w in split.items():
        n = min(least, len(w))
        for q in range(len(w) - n + 1 if n else 0):
            table.setdefault((n, *w[q : q + n]), []).append((i, q))
    sizes = sorted({k[0] for k in table})
    out = {}
    for d, t in docs.items():
        w = words(t)
        for p in range(len(w)):
            for n in sizes:
                for i, q in table.get((n, *w[p : p + n]), ()):
                    k = n
                    while p + k < len(w) and q + k < len(split[i]) and w[p + k] == split[i][q + k]:
                        k += 1
                    if (d, i) not in out or (-k, p, q) < (-out[d, i][0], *out[d, i][1:]):
                        out[d, i] = (k, p, q)
    return out


def propagated(links, size, shards, cap, rounds=30):
    """Weight of links within shards after label propagation one document at a time: {doc: shard}.  links: {unit: (weight, docs)}."""
    of = {}
    for u, (_, docs) in links.items():
        for d in docs:
            of.setdefault(d, []).append(u)
    label, full = {}, [0] * shards
    for k, d in enumerate(sorted(of)):
        s = k % shards
        label[d] = s
        full[s] += size[d]
    for _ in range(rounds):
        moved = 0
        for d in sorted(of):
            score = Counter()
            for u in of[d]:
                for e in links[u][1]:
                    if e != d:
                        score[label[e]] += links[u][0] * size[e]
            room = [s for s in score if s != label[d] and full[s] + size[d] <= cap]
            best = max(room, key=lambda s: (score[s], -s), default=None)
            if best is not None and score[best] > score[label[d]]:
                full[label[d]] -= size[d]
                full[best] += size[d]
                label[d] = best
                moved += 1
        if not moved:
            break
    return label


def kept_weight(links, label):
    """Weight of pairs of linked documents that are in one shard, and of all."""
    inside = whole = 0.0
    for w, docs in links.values():
        for a, b in itertools.combinations(docs, 2):
            whole += w
            inside += w * (label[a] == label[b])
    return inside, whole


def language_vector(text, idf, slots, gram_tables):
    """TF-IDF of hashed byte n-grams, byte by byte."""
    low = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    raw = (" " + " ".join(low.split()) + " ").encode()
    count = Counter()
    for i in range(len(raw)):
        h = 0
        for n, table in enumerate(gram_tables):
            if i + n >= len(raw):
                break
            h = (h * 0x01000193 + int(table[raw[i + n]])) & 0xFFFFFFFF
            count[((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - slots.bit_length() + 1)] += 1
    v = {k: math.log1p(c) * float(idf[k]) for k, c in count.items()}
    length = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / length for k, x in v.items()} if length and low.strip() else {}
