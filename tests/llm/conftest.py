import pytest

#: Texts that every operator must stand: null, empty, white space, one word, repeats, odd characters, control strings, very long.
HARD = [None, "", "   \n\t", "one", "same same same same same same same same same same same same", "é ü ß 漢字 \U0001f600 \x1c x", "<|endoftext|> <|im_end|> \\- |bar", "word " * 60_000, "x" * 200_000]
#: Columns with the names that operators use inside, and others that are common.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, shard int, score double, _tm_x int, t string, x string, best string, h long, start int"


@pytest.fixture(scope="session")
def hard(spark):
    """Hard texts, a repeated row, a repeated id with another text, and null ids; clashing columns beside them."""
    rows = [(i, t) for i, t in enumerate(HARD)] + [(1, ""), (3, "one"), (3, "other words here"), (None, "no id at all"), (None, None)]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None, "t", "x", "b", None, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")
