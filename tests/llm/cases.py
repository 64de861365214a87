"""Small tables with every awkward row, and brute-force helpers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, copies string, n_words string"


def awkward(n: int = 60, seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    base = [text(60) for _ in range(5)]
    rows = [(k, text(rng.randint(1, 80)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), 0) for k in range(n)]
    rows += [(n, None, "en", "a", None), (n + 1, "", None, None, 0), (n + 2, " \t\n ", "en", "a", 3), (None, base[0], "en", "a", 1), (n + 3, text(20_000), "en", "b", 1), (n + 4, "é" * 50_000, "fr", "b", 1), (n + 5, "one", "en", "c", 3), (n + 6, "one two", "en", "c", 7), (n + 7, "ONE  Two", "en", "c", 8)]
    for k in range(12):  # near copies: one word changed
        b = base[k % 5].split()
        b[rng.randrange(60)] = "new"
        rows.append((n + 10 + k, " ".join(b), "en", "a", 1))
    rows += [(n + 30 + k, base[k % 5].upper() if k % 2 else base[k % 5], "fr", "c", 1) for k in range(10)]
    rows += rows[3:6]  # repeated rows
    rows.append((5, "same id, other text", "en", "a", 1))
    return [(*r, "1", "x", None) for r in rows]


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def sets(text, width=3):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def groups(items: list, linked) -> list[int]:
    """Place of the first member of each item's group."""
    at = list(range(len(items)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return [root(i) for i in range(len(items))]
