import pyarrow.dataset as ds

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, one word, repeated rows, a null id, and one very long text.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "the same words of one text here again"),
       (5, "the same words of one text here again"), (6, "the same words of one text here again"),
       (None, "a text without an id"), (7, "é ü ñ ß 日本語 \U0001F600 <|endoftext|> don't"),
       (8, "long words go on and on " * 4000)]


def pandas_table(sf, name, columns=None):
    return ds.dataset(f"{sf}/{name}.parquet").to_table(columns=columns).to_pandas()


def odd_documents(spark, extra=()):
    """Odd rows with the columns of documents and extra ones (name, value)."""
    rows = [(i, t, "en", "s", len(t or ""), *[v for _, v in extra]) for i, t in ODD]
    return spark.createDataFrame(rows, DOCS + "".join(f", {n} {'long' if isinstance(v, int) else 'string'}"
                                                      for n, v in extra))


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)
