import random
import re

SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]


def words(rnd, n):
    return ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3))) for _ in range(n)]


def edited(rnd, text, share):
    return " ".join(w if rnd.random() > share else "zz" + w for w in text.split())


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, null, empty, blank and short ones."""
    rnd = random.Random(seed)
    base = [" ".join(words(rnd, rnd.randint(20, 120))) for _ in range(n)]
    passage = " ".join(words(rnd, 40))
    out = [*base, *base[:4], base[0], base[0]]
    out += [edited(rnd, t, 0.01) for t in base[:12]] + [edited(rnd, t, 0.03) for t in base[:12]]
    out += [f"{t} {passage} {b}" for t, b in zip(base[20:26], base[26:32], strict=True)]
    out += [None, None, "", "", " \n", "one", "one two", "ONE, two!", "é ñ ü " * 30]
    rnd.shuffle(out)
    return out


def shingles(text, k=5):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def frame(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)
