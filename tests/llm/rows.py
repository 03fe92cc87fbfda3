"""Small tables with nulls, empty texts, ties, repeats and clashing columns."""

import random

SCHEMA = "doc_id long, text string, source string, size long, kept string, position double, label int"


def sentence(rng: random.Random, n: int, words: int = 60) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def documents(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    base = sentence(rng, 120, 5000)
    near = base.split()
    near[10] = "changed"
    passage = sentence(rng, 50, 5000)
    texts = [None, "", "   \n", "one", "one two three", base, base, " ".join(near), base.upper(), "x" * 20_000, sentence(rng, 6000, 5000),
             passage + " tail one", "head two " + passage, passage + " " + passage, "a b " * 200, "ärger über straße 😀 <|im_end|>"]
    rows = [(i * 3, t, random.Random(i).choice(["s", "t", None]), 7, "k", 0.5, 1) for i, t in enumerate(texts)]
    return [*rows, (3, "one", "s", None, None, None, None), (18, base, "s", 7, "k", 0.5, 1), (None, "one two three", "u", 1, "k", 0.1, 0), (None, base, None, 1, "k", 0.1, 0)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words(text, True)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
