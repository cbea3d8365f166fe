"""Plain Python versions of the corpus operators' contracts, and small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), vocabulary)}{'abcdefgh'[i % 8]}"
                    for i in (rng.randrange(64) for _ in range(n)))


def odd_docs():
    """Nulls, empty and blank texts, repeated rows, odd white space, one very long text."""
    long = " ".join(f"x{i % 977}" for i in range(30_000))
    return [doc(9001, None), doc(9002, ""), doc(9003, " \t\n"), doc(None, "a text without an id at all"),
            doc(9004, "one"), doc(9004, "one"), doc(9005, "a b\x1cc  d\x0be\n\nf", None, None),
            doc(9006, long, "de", None), doc(9007, "é" * 50 + " ÀB cD", None, "s1"), (None, None, None, None, None)]


def shingles(text, size):
    w = WORD.findall((text or "").translate(AZ))
    if not w:
        return set()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))}


def components(docs, size, percent=80):
    """``doc_id -> (set size, component)`` for distinct, non-null ids."""
    sets = {d[0]: shingles(d[1], size) for d in docs if d[0] is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def contamination(text, items, window=13):
    w = PLAIN.findall((text or "").translate(AZ))
    hit, names = set(), set()
    for item, body in items:
        v = PLAIN.findall((body or "").translate(AZ))
        for i in range(max(1, len(v) - window + 1) if v else 0):
            p = v[i:i + window]
            for k in range(len(w) - len(p) + 1):
                if w[k:k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    names.add(str(item))
    return len(w), len(hit), sorted(names)


def substring_dedup(docs, window=50):
    starts = defaultdict(set)
    texts = [(d[0], WORD.findall(d[1] or "")) for d in docs]
    for i, w in texts:
        for k in range(len(w) - window + 1):
            if i is not None:
                starts[tuple(w[k:k + window])].add(i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and min(starts[tuple(w[k:k + window])]) < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(repeated), failed)


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared passages, junk and odd rows."""
    rng = random.Random(seed)
    docs = [doc(i, prose(rng, rng.choice([3, 30, 80, 200])), "en" if i % 3 else "fr", f"s{i % 2}")
            for i in range(n)]
    passage = prose(rng, 70, 5000)
    for k in range(12):
        base = docs[rng.randrange(n)][1].split()
        near = list(base)
        near[len(near) // 2] = "changed"
        docs += [doc(1000 + 10 * k, " ".join(base)), doc(1001 + 10 * k, " ".join(near)),
                 doc(1002 + 10 * k, prose(rng, 20) + " " + passage + " " + prose(rng, 20)),
                 doc(1003 + 10 * k, "\n".join(["the same line here"] * 5 + [prose(rng, 60)]))]
    return docs + odd_docs()
