"""Small tables with the awkward cases: nulls, empty and long texts, repeats, clashing column names."""

import random

WORDS = ["red", "blue", "Grün", "été", "stone", "river", "42", "moon", "salt", "wind", "corn", "iron"]


def prose(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + str(r.randrange(60)))
        if r.random() < 0.1:
            out[-1] += r.choice([".", ",", ".\n", "!!"])
    return " ".join(out)


def awkward_rows():
    shared = prose(1, 40)
    rows = [
        (1, prose(2, 60), "a"),
        (2, None, "a"),
        (3, "", "b"),
        (4, shared, "a"),
        (5, shared, None),
        (6, shared + " extra tail", "b"),
        (7, prose(3, 3000), "a"),
        (8, " \n\t ", "b"),
        (9, "one", "c"),
        (9, "one", "c"),
        (9, "two words", "c"),
        (12, "x" * 400, "a"),
        (13, prose(4, 20) + shared + prose(5, 20), "b"),
        (14, "日本語 テキスト " * 10, "a"),
        (None, shared, "a"),
        (None, "no key", None),
    ]
    return rows


def awkward(spark, parts=3):
    """doc_id, text, source and columns whose names clash with what operators add."""
    clash = "score double, shard int, _row string, _t string, slot long, `n_words` int, fingerprint string, `odd.name` int, epoch int, rank int, _k long"
    data = [(k, t, s, 0.5, 7, "r", "t", 1, 2, "f", 3, 4, 5, 6) for k, t, s in awkward_rows()]
    return spark.createDataFrame(data, f"doc_id long, text string, source string, {clash}").repartition(parts)


def plain(spark, rows, schema="doc_id long, text string, source string", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)
