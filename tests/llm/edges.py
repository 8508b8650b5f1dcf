"""Documents that are hard on an operator."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, language string, shard string, rank string, n string, frames string"
_EXTRA = tuple("extra" for _ in range(7))


def rows(more=()):
    text = "the quick brown fox jumps over the lazy dog and runs away from the hunters in the wood " * 4
    base = [
        (None, "a row without a key", "en"),
        (1, None, "en"),
        (2, "", None),
        (3, "x" * 60_000, "en"),
        (4, "word " * 20_000, "en"),
        (5, text, "en"),
        (5, text, "en"),
        (6, text, "en"),
        (7, " \n\t ", "en"),
        (8, "Ünïcödé ☃ 日本語 \U0001f600 ▁ \0 end", "de"),
        *[(d, t, lang) for d, t, lang in more],
    ]
    return [(d, t, lang, "s", None if t is None else len(t), *_EXTRA) for d, t, lang in base]


def documents(spark, more=()):
    return spark.createDataFrame(rows(more), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
