"""Small tables for the tests of the operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, token string, comp string, row string, spans string, stratum string, words string"
PRIOR = re.compile("[A-Z]")


def words_of(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", PRIOR.sub(lambda m: m[0].lower(), text) if lower else text)


def table(spark, rows):
    """``(doc_id, text)`` or ``(doc_id, text, lang)`` rows with further columns whose names the operators use inside."""
    full = []
    for row in rows:
        doc_id, text, lang = (*row, "en")[:3]
        full.append((doc_id, text, lang, "s1", len(text or ""), 1, 2, "t", "c", "r", "x", "y", "w"))
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, vocabulary=5000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, every):
    """The text with one word in ``every`` changed."""
    draw = random.Random(seed)
    return " ".join(f"x{draw.randrange(10**6)}" if draw.randrange(every) == 0 else w for w in text.split())


ODD = [(90100, None), (90101, ""), (90102, " \t\n"), (90103, "one"), (90104, "One"), (90105, "two three four five"), (None, "a null id of its own here"), (90106, "ÄÖ é ß 漢字 \x01 ' don't a b")]
