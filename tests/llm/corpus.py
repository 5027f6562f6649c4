"""Small corpora with the odd cases, and brute-force versions of the operators."""

import collections
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows(seed=1, n=60):
    """Texts with exact copies, near copies, case variants, nulls, empty and blank texts, ties and a long text."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(200)]
    made = []
    for i in range(n):
        made.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 60))))
    long = made[0].split()
    made += [made[0], made[0].upper(), " ".join([*long[:-1], "changed"]), None, None, "", " \n\t ", "one", "One two", "one two", "a\nb\na\nb\nc", " ".join(vocabulary * 40)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(30):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(len(copy))] = "new" + str(rng.random())
        made.append(" ".join(copy))
    sources = ["s1", "s2", None, "s3"]
    return [(i, t, ("en", "fr", None)[i % 3], sources[0] if i % 3 == 0 else sources[i % 4], len(t or "")) for i, t in enumerate(made)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def held_out(doc_id, modulus, rest=2):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def jaccard_components(data, percent=90, width=3):
    """doc_id to (size, component, links to different sets)."""
    sets = {}
    for doc_id, text, *_ in data:
        w = words(lower(text))
        sets[doc_id] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
                    if sets[a] != sets[b]:
                        links[a].add(sets[b])
                        links[b].add(sets[a])
    return {d: (len(s), find(d), len(links[d])) for d, s in sets.items()}


def quality(text, min_words=8, max_covered=0.3, max_longest=100, long_share=0.2):
    """The base figures and the verdict, with all suffixes compared."""
    w = words(text)
    n = len(w)
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    again = {j for i in range(n - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    order = sorted(range(n), key=lambda i: w[i:])
    longest = [0] * n
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < n and w[a + k] == w[b + k]:
            k += 1
        longest[a], longest[b] = max(longest[a], k), max(longest[b], k)
    covered = {j for i, k in enumerate(longest) if k >= min_words for j in range(i, i + k)}
    top = max(longest, default=0)
    failed = n < 10 or 100 * len(again) > 20 * n
    kept = not failed and len(covered) <= max_covered * n and not (top > max_longest and top > long_share * n)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), duplicates, len(again), failed, kept, len(covered), top)
