import random
import re

SCHEMA = "doc_id long, text string"
WHITE = re.compile("[ \t\n\x0b\x0c\r]+")


def documents(spark, texts, first=0):
    """A table of (doc_id, text) with columns whose names the operators use themselves."""
    rows = [(first + i, t, "x", 1, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"{SCHEMA}, key string, n long, kept boolean")


def saved(spark, path, docs, **others):
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    for name, df in others.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def prose(seed, words, vocabulary=4000):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(words))


def shingles(text):
    words = re.findall("[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def linked_components(pairs, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def near_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    pairs = []
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                pairs.append((i, j))
    return linked_components(pairs, ids)


def edited(text, seed, edits):
    rnd = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return " ".join(words)
