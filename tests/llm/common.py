import random
import re

LETTERS = "abcdefghijklmnopqrstuvwxyzéß"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(
        "".join(draw.choice(LETTERS) for _ in range(draw.randint(2, 9))) for _ in range(n)
    )


def documents(spark, rows):
    """Rows of doc_id and text, with further columns of names that operators use inside."""
    schema = "doc_id long, text string, lang string, id long, key long, row string, `a b` int"
    return spark.createDataFrame([(i, t, "en", 1, 2, None, 3) for i, t in rows], schema)


ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three four"), (5, "one two three four"),
    (None, "nameless text of some words here"), (6, "a" * 5000), (7, "x y " * 3000),
]
