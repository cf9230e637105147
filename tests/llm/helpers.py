"""Small tables with awkward rows, and plain-Python versions of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SHAPE = "doc_id long, text string, keys string, score double, kept string, ids string, _row string"


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def table(spark, texts, parts=3):
    """Documents 0, 1, ... with extra columns whose names operators use for themselves."""
    rows = [(i, t, "k", 0.5, "x", "y", "z") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, SHAPE).repartition(parts)


def awkward(rng):
    """Texts with copies, near copies, shared passages, nothing, only spaces, one word, signs, and one very long text."""
    base = [prose(rng, rng.randrange(5, 120)) for _ in range(12)]
    shared = prose(rng, 60)
    near = base[3].split(" ")
    near[len(near) // 2] = "changed"
    long_text = prose(rng, 9000, 5000)
    return [*base, base[0], base[0], " ".join(near), f"{base[1]} {shared}", f"{shared}\n{base[2]}", None, "", " \t\n ", "one", "one two", "a" * 3000, "é ü 世界 😀  x", "the " * 200, long_text, long_text + " end",
            "<|endoftext|> x <|endoftext|>", "I'll won't  \n\n  spaces   'S", "\x00\x1c\x85\xa0 x"]
