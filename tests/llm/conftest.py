import random

import pytest

#: Names that operators use inside themselves.
CLASHING = ["id", "key", "tie", "row", "size", "n", "part", "list", "features", "ids", "cls", "h", "spans", "_id", "_text", "doc", "taken", "lang_pred", "score", "copies", "position"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture
def table(spark):
    """A table of documents with clashing extra columns from (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture
def odd_rows():
    """Null ids, texts, langs and sources; empty, blank and very long texts; repeated rows; marks that tokenizers treat specially."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    shared = words(rng, 120)
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n\x0b\x0c\r ", None, None),
        (4, long, "en", "b"),
        (5, "one two  three\n\nfour five ▁ ▁x <|endoftext|> <|STARTOFTEXT|>.", "en", "b"),
        (6, "Ünïcödé. é. ́x İI K ﬁ 日本語 テスト 😀😀 'S it's I'LL a,b;c d.e", "de", "a"),
        (7, shared + " tail one", "en", None),
        (8, "head two " + shared, "fr", "c"),
        (8, "head two " + shared, "fr", "c"),
        (8, "another text under the same id " + shared, "fr", "c"),
        (None, "no id here " + shared, "en", "a"),
        (None, None, None, None),
        (9, "<s> </s> <unk> special strings <0x0A>", "en", "a"),
        (10, "same same same same\nsame same same same\n" * 30, "en", "a"),
        (11, "word", "en", "zz"),
        (12, "\n".join(["line of words here"] * 3), "en", "zz"),
        (13, "12345 67890 --- ###", "en", "zz"),
    ]


@pytest.fixture
def no_rows(table):
    return table([]).limit(0)
