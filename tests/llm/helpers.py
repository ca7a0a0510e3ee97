import random
from collections import defaultdict


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(random.Random(i).choices("abcdefghilmnoprstuvz", k=2 + i % 9)) for i in range(vocabulary)]
    return " ".join(r.choice(words) + ("," if r.random() < 0.1 else "") for _ in range(n))


def rows_by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out
