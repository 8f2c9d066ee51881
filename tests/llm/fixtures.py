"""Documents with every awkward case, and plain-Python expectations that the operators are held to."""

import collections
import random
import re

LONG = " ".join(f"word{i % 700} ünd{i % 13}." for i in range(20_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, kept string, key int, made string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def messy_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; extra columns named like internals."""
    texts = [
        (None, None, None, None), (0, None, "en", "a"), (1, "", "de", "b"), (1, "", "de", "b"), (2, "   \n\t ", None, "b"),
        (3, LONG, "en", "a"), (None, "The mit license and the MIT License.\x1cX", None, None), (4, "one", "fr", "c"),
        (5, "one two three four five six seven eight " * 6, "en", None), (5, "one two three four five six seven eight " * 6, "en", None),
        (6, "Mail a.b@c.de or +1 (212) 555-1234, host 10.0.0.1, card 4111 1111 1111 1111.\nline\nline", "en", "a"),
        (7, "日本語 テキスト  İΣς \U0001F600 <|endoftext|>", "ja", "d"), (8, "12345 67890 !!! ???", "en", "a"),
        (9, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0; gnu general public license v3", "en", "d"),
    ]
    return [(*t, None if t[1] is None else len(t[1]), "r", 7, "yes", 3, "m") for t in texts]


def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    words = [rng.choice(["river", "stone", "light", "under", "whisper", "garden", "slowly", "between"]) + str(rng.randrange(90)) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def words(text) -> list:
    return WORD.findall(text or "")


def base_measures(text) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
