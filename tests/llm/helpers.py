"""Frames with the awkward cases: nulls, empty and long texts, repeated rows, extra columns that clash."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, row int, shard int, rid string"


def docs(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, None, s, None, 7, "k", 1, 2, "r") for i, t, s in rows], DOCS)


def awkward(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, "alpha beta gamma delta epsilon zeta", "a"), (1, "alpha beta gamma delta epsilon zeta", "a"), (2, None, None), (None, "x", "b"), (None, None, None), (3, "", "a"), (4, " \t\n", ""), (5, long, "b"), (6, long + " end", "b"), (7, "é ü 漢字 😀 alpha", "a")]
    return docs(spark, rows)


def put(tmp_path, **frames):
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
