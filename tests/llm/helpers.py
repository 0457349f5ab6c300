"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = ["the", "river", "of", "stone", "and", "light", "over", "green", "hill", "water", "long",
         "road", "small", "house", "with", "wind", "in", "tree", "bird", "morning"]
FREMD = ["der", "fluss", "und", "stein", "das", "licht", "über", "grün", "hügel", "wasser", "lang",
         "weg", "klein", "haus", "mit", "wind", "im", "baum", "vogel", "morgen"]


def prose(seed: int, n: int, words=WORDS) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def awkward_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, extra columns."""
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 3),
            (4, prose(1, 80), "en", "a", 1), (4, prose(1, 80), "en", "a", 1),
            (5, prose(1, 80), "en", "b", 1), (None, prose(2, 60), "en", "a", 1),
            (None, None, None, None, None), (6, prose(3, 30_000), "en", "c", 1),
            (7, prose(4, 70, FREMD), "de", "c", 1), (8, "!!! 123 ???", "en", "c", 1),
            (9, "x", None, "c", 1), (10, prose(5, 90), None, "c", 1)]
    wide = [(*r, "x", 0.5, "y", [1]) for r in rows]
    return spark.createDataFrame(
        wide, DOC_SCHEMA + ", verdict string, score double, fp string, ids array<int>")


def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
