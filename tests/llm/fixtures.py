"""A small corpus with nulls, blanks, very long texts, copies, near copies, repeated rows and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, letters="abcdefgh"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(text, every):
    words = text.split(" ")
    return " ".join("changed" if k % every == every // 2 else w for k, w in enumerate(words))


BASE = prose(1, 300)
PASSAGE = prose(2, 70)
TEXTS = [
    (1, BASE),
    (2, BASE),
    (2, BASE),  # the same row twice
    (3, edited(BASE, 100)),
    (4, edited(BASE, 12)),
    (5, None),
    (6, ""),
    (7, "  \n\t "),
    (8, "one two"),
    (9, "ONE two"),
    (10, prose(3, 40) + " " + PASSAGE + " " + prose(4, 40)),
    (11, prose(5, 40) + " " + PASSAGE + " " + prose(6, 40)),
    (12, prose(7, 20000)),
    (13, "Été ÉTÉ naïve 数据 данные"),
    (None, BASE),
    (14, "a\x00b c"),
    (15, prose(8, 5)),
]


def documents(spark, rows=TEXTS):
    data = [(i, t, "en", ["s0", "s0", "s1", None][k % 4], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)
