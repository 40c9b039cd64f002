"""Small tables with the cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ka", "to", "mi", "ren", "os", "ul", "ve", "dra"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(seed=1, copies=24):
    """Prose with exact and near copies, a passage that many share, repeated lines, secrets, nulls, empties and a long text."""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    base = "\n".join(sentence(rng, 12) for _ in range(12))
    texts = [None, "", "  \n\t ", "one", "one", "two words", "two words", "a b c d", "A B C D", "x y z w v u", sentence(rng, 30000)]
    for _ in range(copies):
        words = base.split(" ")
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = sentence(rng, 1) + str(rng.randint(0, 99))
        texts.append(" ".join(words))
    texts += [base] * 3
    texts += [sentence(rng, 40) + "\n" + passage + "\n" + sentence(rng, 40) for _ in range(10)]
    texts += ["\n".join(sentence(rng, rng.randint(1, 15)) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    texts += ["All rights reserved here.\n" + sentence(rng, 20) for _ in range(5)]
    return [(i, t, None if i % 7 == 0 else "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows=None):
    """The documents with columns whose names clash with those that operators use."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3, "doc_id")
    return df.selectExpr("*", "1 AS n", "'x' AS hi", "2 AS key", "'y' AS spans", "3 AS part", "false AS kept", "0 AS component_id")


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    size = min(5, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def similar(x, y):
    k = len(x & y)
    return bool(k) and 100 * k >= 75 * (len(x) + len(y) - k)


def later_lines(rows):
    """{doc_id: numbers of lines with a similar one before them}"""
    seen, out = [], {}
    for doc, text, *_ in sorted(rows):
        for i, line in enumerate((text or "").split("\n")):
            words = line.encode().lower().split()
            if len(words) >= 3:
                s = frozenset(words)
                if any(similar(s, t) for t in seen):
                    out.setdefault(doc, []).append(i)
                seen.append(s)
    return out
