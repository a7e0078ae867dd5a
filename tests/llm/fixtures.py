"""Small hostile tables of statement texts, and helpers."""

import random

SHAPE = "stmt_id bigint, text string, lang string, score double, n bigint, component_id bigint"


def prose(rng: random.Random, n: int, syllables=("the", "an", "er", "in", "on", "ti", "es", "re", "st", "en")) -> str:
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def statements(spark, rows):
    """Rows (stmt_id, text[, lang]) with extra columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, 0.5, 7, -1) for r in rows]
    return spark.createDataFrame(full, SHAPE)


def hostile_rows(seed: int = 3):
    """Nulls, empty and very long texts, exact and near copies, repeated rows and ids, odd blanks."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(20, 60)]
    long = prose(rng, 30_000)
    copy = rows[3][1]
    near = rows[5][1].split(" ")
    near[len(near) // 2] = "changed"
    rows += [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, copy), (7, copy), (7, copy), (8, " ".join(near)),
             (9, "é" * 40 + " ü " * 30), (10, "x"), (None, copy), (None, None), (11, "a\u00a0b\u2003c  d\r\n e"),
             (12, "12 34 %% !!"), (13, copy + "\n" + long[:400]), (14, "ABC " + copy.upper()), (60, "aaaa" * 60),
             (61, "b" + "aaaa" * 50)]
    rng.shuffle(rows)
    return rows
