"""Small tables with the awkward rows every operator must take."""
import random

LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def words(n, seed, vocab=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def edge_docs(spark, extra="pos int, key string, rid long, fp long, h1 long, kept_text string"):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names."""
    a = words(60, 1)
    rows = [(0, a, "en"), (1, a, "en"), (1, a, "en"), (2, None, None), (3, "", "en"), (4, " \n\t", None),
            (5, "one", "fr"), (None, "two words", "fr"), (None, a, None), (6, LONG, "en"),
            (7, "Ünï códe   日本語 ퟿", "de"), (8, "x" * 5000, "de"), (3, "other text of id three", "en")]
    names = [c.split()[0] for c in extra.split(", ")]
    fill = tuple({"int": 1, "long": 2, "string": "s"}[c.split()[1]] for c in extra.split(", "))
    schema = "doc_id long, text string, lang string, " + extra
    return spark.createDataFrame([r + fill for r in rows], schema), rows, names


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
