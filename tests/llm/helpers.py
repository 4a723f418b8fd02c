"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "row string, k long, h long, recipe string, words string, keep_id long, lone long, size long")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def frame(spark, rows, parts=3):
    """rows: (doc_id, text[, lang]). The extra columns clash with working names of the operators."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None, "x", 1, 2, "r", "w", 7, 8, 9) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n))


def awkward():
    """Null, empty, white space, no letters, very long, repeated rows, ties, null ids, other scripts."""
    long_text = "\n".join(prose(s, 40) + "." for s in range(300))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "12 34 !!"), (5, long_text), (6, long_text), (7, "a b"), (8, "A B"), (8, "A B"),
            (None, "a b"), (None, "null id text"), (9, "one"), (10, "日本語 テキスト 😀 ok"), (11, "x" * 5000), (12, prose(1, 60)), (12, prose(2, 60))]
