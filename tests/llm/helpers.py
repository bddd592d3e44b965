"""Small documents with every odd case, and plain-Python versions of what the operators compute."""

from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _b string, rid int"

LOREM = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix bright potions under a pale winter moon and nobody in the village ever asks them why".split()


def passage(k: int, n: int) -> str:
    """n words that differ for each k."""
    return " ".join(f"{LOREM[(i * (k + 3)) % len(LOREM)]}{(i * 7 + k * 13) % 97}" for i in range(n))


def odd_rows():
    """Nulls in any column, empty and blank texts, ties, repeated rows, one very long text, extra columns with clashing names."""
    texts = [
        (0, passage(1, 60)), (1, passage(1, 60)), (2, passage(2, 80)), (3, passage(2, 79) + " changed"), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one two"),
        (9, "żółć\x0bąę  ünï \x0c end.\r\n"), (10, passage(3, 40) + " " + passage(3, 40)), (11, passage(4, 30)), (12, "x " * 50), (13, passage(5, 3000)), (13, passage(5, 3000)),
        (14, passage(2, 80).upper()), (None, passage(6, 50)), (None, None), (15, "12 34 !? 56"), (16, "<|endoftext|> Don't STOP—“now”... a\x01b " + passage(7, 36)), (17, passage(7, 36)),
    ]
    return [(d, t, ["en", None, "fr"][i % 3], ["s1", "s2", None, "ünï"][i % 4], len(t) if t is not None else None, "clash", i) for i, (d, t) in enumerate(texts)]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def shingles(text, n):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_groups(docs, n, percent=80):
    """{doc_id: (size, smallest id of its component)} by comparing all pairs; rows with one id are one node."""
    sets = {}
    for d, t in docs:
        sets.setdefault(d, []).append(shingles(t, n))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def removed_words(docs, window=35):
    """[(doc_id, words, kept words)] by counting all windows."""
    count = Counter(tuple(w[i : i + window]) for _, t in docs for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


def jaccard(a, b):
    """Generalised Jaccard similarity of two texts' word counts."""
    x, y = Counter(words(a)), Counter(words(b))
    both = sum(min(v, y[k]) for k, v in x.items())
    whole = sum(x.values()) + sum(y.values()) - both
    return both / whole if whole else 1.0
