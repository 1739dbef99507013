"""Small tables with the cases every operator must stand: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "amber basin cedar delta ember flint grove harbor island jasper kettle lagoon meadow nectar ochre pebble quarry ridge summit timber".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def odd_rows() -> list[tuple]:
    long_text = prose(99, 30_000)
    return [
        (1, prose(1, 60), "en", "a", 0),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, " \n\t ", "en", None, 0),
        (5, prose(1, 60), "en", "a", 0),
        (6, "é" * 5, "fr", "b", 0),
        (7, long_text, "en", "a", 0),
        (8, "x" * 50_000, "en", "a", 0),
        (9, prose(2, 40) + "\n" + prose(3, 12), "en", "b", 0),
        (9, prose(2, 40) + "\n" + prose(3, 12), "en", "b", 0),
        (None, prose(5, 30), "en", "a", 0),
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
