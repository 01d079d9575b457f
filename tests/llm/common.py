"""Made-up documents for the tests of this subpackage."""

import random

SYLLABLES = {"en": ["th", "e", "an", "d", "ing", "er", "on", "st", "wh"], "fr": ["le", "que", "eau", "ou", "ai", "ent", "é"], "de": ["sch", "ei", "ch", "ung", "en", "ß"]}


def words(rng, n, lang="en", vocabulary=400):
    pick = random.Random(f"{lang}{vocabulary}")
    vocab = ["".join(pick.choice(SYLLABLES[lang]) for _ in range(pick.randint(1, 4))) for _ in range(vocabulary)]
    return [rng.choice(vocab) for _ in range(n)]


def text(rng, n, lang="en"):
    return " ".join(words(rng, n, lang))


def documents(spark, rows):
    """(doc_id, text, lang, source) with the columns of the table, and columns whose names clash with those of the operators."""
    full = [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def with_clashes(df):
    from pyspark.sql import functions as F

    names = ["key", "part", "mass", "kind", "score", "a", "b", "u", "v", "node", "root", "doc", "pos", "ref", "bucket", "digest", "copies", "rate", "url_key", "at", "want", "__n", "__same", "__gone", "__cut", "__id", "__h", "__lang", "__text", "__first", "i", "l", "h", "t", "copy_no"]
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])


def rows_of_all_kinds(rng):
    """Rows (doc_id, text, lang, source) with nulls, empty and very long texts, repeated rows and doc_ids."""
    base = text(rng, 120)
    return [(1, base, "en", "a"), (1, base, "en", "a"), (1, text(rng, 90), "fr", "b"), (2, None, None, None), (3, "", "en", "a"), (None, base, "en", "a"), (None, None, None, None), (4, "?! ...", "de", "b"), (5, text(rng, 20000), "en", None), (6, base + " more", None, "a"), (7, "one", "en", "a"), (8, "one", "en", "a")]
