"""Small documents with every odd case, and plain words for brute force."""

import random
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYL = ["the", "an", "on", "er", "Re", "th", "ing", "É", "ch", "ß", "ou", "le", "7", "ñ"]


def words(t, pattern):
    return re.findall(pattern, (t or "").translate(LOW))


def alnum(t):
    return words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced(t):
    return words(t, r"[^\x20\x09-\x0D]+")


def text(r, n):
    return " ".join("".join(r.choice(SYL) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text, lang) rows with the other columns and clashing extra ones."""
    extra = ["kept", "comp", "key", "worker", "n", "g", "rep", "__x"]
    full = [(i, t, lang, "src0", None if t is None else len(t), *[1] * len(extra)) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{e}` int" for e in extra)
    return spark.createDataFrame(full, schema).repartition(3)


def mixed(seed=1, n=60):
    r = random.Random(seed)
    base = [text(r, r.randint(20, 120)) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        t = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 8])):
            t[r.randrange(len(t))] = text(r, 1)
        rows.append((i, " ".join(t), r.choice(["en", "de", None])))
    odd = ["", None, " \n\t ", "one", "two words", "three short words", "!!! ...", "a" * 3000, "x " * 5000, "é ü ß", "A B C D", "a b c d", "a b c d"]
    rows += [(1000 + i, t, "en") for i, t in enumerate(odd)]
    rows += [(None, base[0], "en"), (3, rows[3][1], "en"), (3, rows[3][1], "en")]
    return rows
