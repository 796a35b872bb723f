"""Rows that the tests share."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(n, lang="en", seed=0):
    """Words of a language, the same for the same seed."""
    import random

    r = random.Random(f"{lang}{seed}")
    parts = {"en": ["the", "th", "ing", "er", "and", "ou", "wh"], "de": ["ein", "sch", "ung", "ber", "der", "ä"], "fr": ["eau", "eux", "le", "ment", "é", "oi"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n", None, None, 3),
    (4, "one", "en", "b", 3),
    (5, "one two", "en", "b", 7),
    (6, plain(30_000, seed=6), "en", "a", None),
    (7, plain(50, seed=7), "en", "a", None),
    (7, plain(50, seed=7), "en", "a", None),
    (8, plain(50, seed=7), "de", "b", None),
    (None, plain(40, "de", 9), "de", None, None),
    (None, None, None, None, None),
    (9, "日本語 text é \x00 \U0001f600", "fr", "c", None),
    (10, "!!! 123 ???", "fr", "c", None),
    (11, " " * 1_500_000 + "x", "en", "a", None),
    (12, "zq" * 300_000, "en", "a", None),
]
