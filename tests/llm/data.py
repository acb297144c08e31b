"""Small tables with the awkward cases: nulls, empties, repeats, ties, long texts, clashing columns."""

import random

WORDS = "the of and rain field stone über café niño river low high run".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) * (r.random() < 0.5) for _ in range(n))


def documents(spark, rows, extra=True):
    """doc_id, text, lang, source, n_chars and columns whose names operators use inside."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long" + (", id long, key string, th long, w string, fp long, own int, block int" if extra else "")
    pad = (1, "x", 2, "y", 3, 4, 5) if extra else ()
    return spark.createDataFrame([(*r, *pad) for r in rows], ddl)


def awkward():
    a = prose(1, 120)
    return [
        (1, a, "en", "s0", 1), (2, a, "en", "s0", 1), (2, a, "en", "s0", 1), (3, None, "en", "s1", None), (4, "", None, "s0", 0), (5, " \t\n\r ", "de", None, 5),
        (None, prose(2, 80), "en", "s0", 1), (None, None, None, None, None), (6, a.upper(), "en", "s0", 1), (7, prose(3, 90) + " zz", "en", "s0", 1), (8, prose(3, 90), "en", "s0", 1),
        (9, prose(4, 30000), "fr", "s2", 1), (10, "same line here\n" * 40, "en", "s0", 1), (11, "\U0001f600 é\x00 x", "en", "s0", 3), (12, "one two", "en", "s0", 7), (13, "!! ## " * 80, "en", "s0", 1),
    ]
