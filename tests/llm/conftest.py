import pytest

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"

ODD_TEXTS = [
    None, "", " ", "\n\n", "word", "a\x1cb c", "a\x85b", "İΑΣ ΟΔΟΣ", "x<|endoftext|>y <|startoftext|>", "don't'S",
    "日本語 ﬁ½²Ⅷ", "é ́a", "aaaaaaaaaaaaa", "a\x00b", "same text", "same text", "zwölf Boxkämpfer jagen",
]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, with ids in order and a column whose name operators use inside."""

    def make(texts, ids=None, **columns):
        rows = [
            (i, t, "en", f"src{k % 3}", None if t is None else len(t), *[c[k] for c in columns.values()])
            for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))
        ]
        extra = "".join(f", {name} string" for name in columns)
        return spark.createDataFrame(
            rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint{extra}"
        )

    return make


@pytest.fixture(scope="session")
def small_texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
