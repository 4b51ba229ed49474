"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, cid long, rank int, kinds string"


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def rows(texts: dict[int, str | None]) -> list[tuple]:
    """Documents with extra columns whose names clash with the operators' own."""
    return [(i, t, "en", "s", len(t or ""), 0.5, 7, 1, "x") for i, t in texts.items()]


def documents(spark, texts: dict[int, str | None], repeat: tuple[int, ...] = (), parts: int = 3):
    every = rows(texts) + rows({i: texts[i] for i in repeat})
    return spark.createDataFrame(every, DOCS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DOCS)


AWKWARD = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: "one", 6: "Ünïcode “quotes” 中文   \U0001F600 é", 7: words(7, 12_000), 8: "a\x00b \x1c c", 9: "\x85 \xa0 x"}
