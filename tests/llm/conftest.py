import pytest

WORDS = "the harbour lay still under rain until evening boats came in and nobody had told them that road was closed so they waited by gate talking about harvest".split()


@pytest.fixture(scope="session")
def texts():
    """Small documents with every awkward case: nulls, empties, copies, near copies, long texts, odd white space."""
    import random

    r = random.Random(5)
    base = [" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(6)]
    long_text = "\n".join(" ".join(r.choice(WORDS) for _ in range(12)) for _ in range(900))
    out = [(1, base[0]), (2, base[0]), (3, base[0].upper()), (4, base[1] + "\n" + base[2]), (5, base[1] + "\nshort\n" + base[3]), (6, None), (7, ""), (8, "   \n\t "), (9, long_text), (10, "one"), (11, "one two"), (12, "é ü <|endoftext|> x\x1cy z  two  spaces\r\n\n\nend"), (13, base[4].replace("rain", "snow", 1)), (14, base[4]), (15, base[5] + " Licensed under CC-BY 4.0. All rights reserved."), (16, "GNU General\nPublic\tLicense; cc by, CC  BY"), (17, base[0]), (17, base[0])]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "src", len(t or ""), "clash", 0.5) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score double")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
