import random
import string

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, words int, blob string, size long"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1, "y", -1) for i, t, s in rows], COLUMNS)


def stored(spark, rows, folder):
    path = f"{folder}/docs-{random.random()}"
    frame(spark, rows).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, NULLs, empty texts, repeated rows, ties and a very long one."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice(string.ascii_letters[:30] + "éñ") for _ in range(draw.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(draw.randint(1, 120)), f"s{i % 4}") for i in range(90)]
    rows += [(100 + i, rows[i][1], "s0") for i in range(0, 30, 2)]
    rows += [(200 + i, f"{prose(10)} {passage} {prose(5 + i)}", "s1") for i in range(12)]
    rows += [(300 + i, rows[i][1] + " tail", None) for i in range(40, 52)]
    rows += [(400, None, "s0"), (401, "", "s2"), (402, " \t\n", None), (None, passage, "s1"), (None, None, None), (400, None, "s0"), (5, rows[5][1], "s1")]
    rows += [(-7, prose(20_000), "s3"), (500, ("ab cd " * 40).strip(), "s2"), (501, ("ab cd " * 40).strip() + " x", "s2")]
    return rows
