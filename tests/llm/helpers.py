from pyspark.sql import functions as F

LONG = "word " * 30_000
CLASHING = ["fp", "fps", "score", "size", "u", "v", "pos", "starts", "range", "shard", "bin", "y", "fold", "g", "t", "sig", "component_id", "__kept", "__score", "__found", "__made", "__id", "predicted"]


def documents(spark, rows, clashing=True):
    """rows of (doc_id, text); the other columns of the table, null in places, and extra ones whose names clash."""
    full = [(i, t, None if k % 3 == 0 else "en", None if k % 2 else "src0", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if clashing:
        docs = docs.select("*", *[F.lit(str(i)).alias(c) for i, c in enumerate(CLASHING)])
    return docs


def collected(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (None, "no id here at all"), (6, LONG), (7, "é 🙂 漢字 ﬁ x́"), (8, "a\nb\nc\nd\na\nb\nc")]
