"""Hand-made documents that hold the awkward cases, and plain-Python readings of the contracts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, target double, size long"


SYLLABLES = ["ent", "tion", "re", "the", "ing", "sta", "ble", "con", "her", "ver", "ali", "om", "und", "per", "sa", "lic"]


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=4000):
    word = lambda: "".join(SYLLABLES[rng.randrange(vocabulary) % len(SYLLABLES)] for _ in range(3))
    return " ".join(word() + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def documents(seed=0, n=60):
    """Prose with exact and near copies, a passage that many share, nulls, empty, odd and long
    texts, and columns whose names clash with those that operators add."""
    rng = random.Random(seed)
    passage = prose(rng, 40)
    texts = [prose(rng, rng.choice([1, 2, 3, 4, 5, 30, 80, 200])) for _ in range(n)]
    for i in range(0, n, 6):
        texts[i] += " " + passage
    base = prose(rng, 300)
    for i in range(8):  # near copies: a word or two changed
        w = base.split(" ")
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = f"zz{i}"
        texts.append(" ".join(w))
    texts += [base, base.upper(), None, "", " \n\t ", "é ß İ ΣΑΣ <|endoftext|> 'tis a's.", "x" * 5000, prose(rng, 6000), "one. two! three?\n" * 80, None, ""]
    sources = ["b", "a", None, "Z", "hot", "hot", "hot"]
    return [(i * 3 + 1, t, rng.choice(["en", None, "xx"]), sources[i % len(sources)], len(t or ""), 7, 0.5, 9) for i, t in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)


def shingles(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def classes(rows, k, percent):
    """doc_id -> (set size, smallest doc_id reached), by testing all pairs."""
    sets = {r[0]: shingles(r[1], k) for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def link_counts(rows, k, percent):
    """doc_id -> number of other rows that it links with, by testing all pairs."""
    sets = [(r[0], shingles(r[1], k)) for r in rows]
    out = dict.fromkeys((d for d, _ in sets), 0)
    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                out[a] += 1
                out[b] += 1
    return out
