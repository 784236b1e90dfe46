"""Small tables with what real ones hold: nulls, empty and long texts, ties,
repeated rows, and columns whose names clash with the operators' own."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, cid long, k1 long,"
          " n_words long, spans string, score string")


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["über", "año", "été"]
    rows = []
    for f in range(4):
        base = sentence(rng, words, 40 + 60 * f).split()
        for i in range(12):
            b = list(base)
            for _ in range(rng.randint(0, 3)):
                b[rng.randrange(len(b))] = rng.choice(words)
            rows.append((f * 100 + i, " ".join(b)))
    passage = sentence(rng, [f"p{i}é" for i in range(60)], 110)
    rows += [(1000 + i, sentence(rng, words, rng.randint(0, 90)) + " " + passage + " " + sentence(rng, words, 20))
             for i in range(12)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "One two"), (2004, "one TWO"), (2005, "a" * 1500),
             (2006, "ab" * 900), (2007, sentence(rng, words, 9000)), (2008, "£$%^ 123"), (2009, rows[0][1]),
             (2009, rows[0][1]), (2009, rows[1][1]), (None, rows[2][1]), (None, None)]
    langs = ["en", "de", None]
    return [(i, t, langs[k % 3], f"s{k % 4}" if k % 7 else None, None if t is None else len(t), "row", 7, 8, 9, "x", "y")
            for k, (i, t) in enumerate(rows)]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
