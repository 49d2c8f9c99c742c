"""Small documents with every odd case, for all operators."""

import pytest

WORDS = "der the la of und and en que which ist would maison house perro river station garden letter window"


def prose(seed: int, n: int) -> str:
    """Words that follow from a seed."""
    pool, out, x = WORDS.split(), [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(pool[(x >> 16) % len(pool)] + str((x >> 8) % 97))
    return " ".join(out)


ROWS = [
    (0, prose(1, 120), "en", "a"),
    (1, prose(1, 120), "en", "a"),
    (2, prose(1, 119) + " other", None, "a"),
    (3, None, "en", "b"),
    (4, "", "de", "b"),
    (5, "   \n\t ", "de", None),
    (6, "one two", "en", None),
    (7, "é" * 40 + " ß日本語 " + prose(2, 60), "de", "b"),
    (8, "x" * 20000, "en", "b"),
    (9, prose(3, 4000), "en", "c"),
    (10, "write a.b@mail.example.com or +1 (504) 555-2652 from 10.1.2.3 with 4111 1111 1111 1111", "en", "c"),
    (10, "write a.b@mail.example.com or +1 (504) 555-2652 from 10.1.2.3 with 4111 1111 1111 1111", "en", "c"),
    (11, prose(4, 50) + "\n" + prose(1, 60) + "\n" + prose(1, 60), "fr", "c"),
    (11, prose(5, 80), "fr", "c"),
    (None, prose(6, 70), "fr", None),
    (None, prose(1, 120), None, None),
    (-5, "<|endoftext|> don't STOP!!! ﬁ É 12.5% <|startoftext|>", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside.
CLASHES = "node tie part value label row bands hash rid k words lines text_a fingerprint lang_pred score payload digest number n_words held_out".split()


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
