import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = {
    "en": ["the", "ing", "and", "er", "tion", "of", "sh", "ea", "st", "wh"],
    "de": ["der", "ung", "sch", "keit", "ä", "ü", "ver", "pf", "tz", "ei"],
    "fr": ["le", "eau", "que", "é", "è", "ou", "ment", "ç", "ai", "eux"],
}


def prose(rng, lang, n):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    lines, at = [], 0
    while at < n:
        size = rng.randint(4, 18)
        lines.append(" ".join(words[at : at + size]).capitalize() + ".")
        at += size
    return "\n".join(lines)


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: prose, copies, junk, nulls, empty, blank and long texts, repeated rows."""
    rng = random.Random(11)
    rows = []
    for i in range(90):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.randint(3, 220)), lang))
    long_text = prose(rng, "en", 9000)
    rows += [
        (100, None, "en"), (101, "", None), (102, " \n\t ", "en"), (103, "12 34 !!", None), (104, long_text, "en"),
        (105, rows[7][1], rows[7][2]), (106, rows[7][1] + " extra", "en"), (107, rows[8][1], None), (107, rows[8][1], None),
        (None, rows[9][1], "fr"), (None, None, None), (108, "one", "en"), (109, "again again again " * 80, "en"),
        (110, "x" * 5000, "de"), (111, "A\x1cB\x85C D ́e #*$ <|endoftext|> I'm", "en"),
        (112, rows[3][1] + "\n" + rows[4][1], "de"),
    ]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    """The same rows with further columns whose names operators use themselves."""
    df = spark.createDataFrame(corpus, SCHEMA)
    for name in ("bytes", "own", "node_key", "cut", "copies", "lines_left", "letters", "root", "n_tokens"):
        df = df.selectExpr("*", f"'kept' as {name}")
    return df
