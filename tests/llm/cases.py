"""Small tables with nulls, ties, empty and long texts, and brute force over them."""

import itertools
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts, extra=False):
    rows = [(i, t, "en", f"src{i % 3}" if i and i % 7 else None, len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # clashing names
        from pyspark.sql import functions as F

        for name in ("n_words", "counts", "node", "component_id", "copies", "size", "target", "kept", "start"):
            df = df.withColumn(name, F.lit("x"))
    return df


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "ß,", "Σ"]
    texts = []
    for i in range(n):
        kind = r.random()
        if kind < 0.45 and texts:
            words = (r.choice(texts)[1] or "").split(" ")
            for _ in range(r.randrange(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 6, 8, 12, 40, 120])))
            if kind > 0.8:
                text = text.replace(" ", "\n", 3) + "\nA line that many documents share here\n"
        texts.append((i, text))
    texts += [(n, None), (n + 1, ""), (n + 2, "  \n\t "), (n + 3, texts[3][1]), (n + 4, texts[3][1]), (n + 5, "x" * 5000 + " y"), (n + 6, "long word " * 4000)]
    return texts


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(texts, percent=75):
    sets = {i: shingles(t) for i, t in texts}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def thue_morse(n, flipped=False):
    """A word of n letters that a polynomial modulo a power of two doesn't tell from the flipped one."""
    return "".join("ab"[(bin(i).count("1") + flipped) % 2] for i in range(n))
