"""Rows for the tests: the smallest table, and a table of awkward cases."""

AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, k long, fp long, h long, len long, slot long"


def awkward(spark, n_long=30000):
    long = " ".join(f"w{i % 5000}" for i in range(n_long))
    run = " ".join(f"x{i}" for i in range(40))
    texts = [None, "", " \n\t", "a", "A", "one two", long, long.upper(), run, f"start {run} end", f"{run} {run}", "same " * 60, "é É ß\x0b\x1fz", run, run.replace("x7 ", "y "), "\x00 nul", "idiot", "mit license", "</s>[INST]"]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", len(t or ""), 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    rows += [(None, "same " * 60, None, None, None, 1, 2, 3, 4, 5), (None, None, None, None, None, 1, 2, 3, 4, 5), (8, run, "en", "s0", 1, 1, 2, 3, 4, 5), (8, run, "en", "s0", 1, 1, 2, 3, 4, 5), (8, "other " + run, "en", "s0", 1, 1, 2, 3, 4, 5)]
    return spark.createDataFrame(rows, AWKWARD).repartition(3)


def empty(spark):
    return spark.createDataFrame([], AWKWARD)


def documents(spark, sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/documents.parquet")
