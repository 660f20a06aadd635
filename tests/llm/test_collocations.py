"""Collocations against counts of all phrases in plain Python."""
import collections
import random
import re

import numpy as np
import pytest

from cohortspark.llm import collocations

FIELDS = "doc_id long, text string, lang string, phrase int, n string, w long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x", 2) for i, (t, g) in enumerate(rows)], FIELDS)


def plain_counts(rows):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            f.update(("und" if lang is None else lang, tuple(w[i:i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    return f, n


def plain(rows, least, top):
    f, n = plain_counts(rows)
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    by_lang = collections.defaultdict(list)
    for (lang, p), a in kept.items():
        if any(lang == g and len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (g, q), b in kept.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        by_lang[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in by_lang.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    words = ["The", "of", "new", "york", "city", "é", "x-y", "\x00", " ", "a" * 70, "　", "zz", "q"] + [f"w{i}" for i in range(40)]
    prose = lambda n: "".join(draw.choice(words[:12] if draw.random() < 0.7 else words) + draw.choice([" ", " ", "  ", "\t", " ", ". ", "\n"]) for _ in range(n))
    made = [(prose(draw.randint(1, 90)), draw.choice(["en", "en", "de", None, "und", ""])) for _ in range(160)]
    made += [("new york city hall " * 60, "en"), ("new york city hall " * 60, "en"), ("same " * 3_000, "de"), (None, "en"), ("", None), (" \t.,", "fr"), (prose(9_000), "en"), ("Of the " * 40, "en")]
    made += [("Of the x. " * 3, "en")] * 30
    return made


@pytest.mark.parametrize("bucket, chunk, marks", [(150_000, 1 << 22, 1 << 26), (40, 700, 1 << 15), (1, 5_000, 1 << 16)])
def test_counts(spark, rows, bucket, chunk, marks):
    got, totals = collocations.frequent_phrases(frame(spark, rows).repartition(4), least=10, bucket=bucket, chunk=chunk, marks=marks)
    f, n = plain_counts(rows)
    counted = [((r["lang"], tuple(r["phrase"].split(" "))), r["f"], r["words"]) for r in got.collect()]
    assert len(counted) == len({k for k, _, _ in counted}) and all(len(k[1]) == m for k, _, m in counted)
    assert {k: a for k, a, _ in counted} == {k: a for k, a in f.items() if a >= 10}
    assert {r["lang"]: r["n"] for r in totals.collect()} == {k: v for k, v in n.items() if v}


@pytest.mark.parametrize("least, top", [(30, 2000), (8, 25)])
def test_top_phrases(spark, rows, least, top):
    got = collocations.mine(frame(spark, rows), least=least, top=top)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == plain(rows, least, top)


def test_counts_beyond_64_bit_products(spark):
    big = 3 * 10 ** 13
    rows = [("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big), ("en", "c", 1, big), ("en", "b c", 2, 40), ("en", "a b c", 3, 40)]
    known = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    got = {r["phrase"]: (r["a"], r["score"]) for r in collocations.scored(known).collect()}
    assert got == {"a b": (big, 2_000_000 * big // (2 * big + 1)), "a b c": (40, 2_000_000 * 40 // (2 * big))}


def test_no_table_of_phrases_is_broadcast(spark, tmp_path):
    """An exploded table counts as its file, a sixteenth of its rows: Spark would gather it in the driver."""
    rows = [("en", "a", 1, 50), ("en", "b", 1, 60), ("en", "c", 1, 40), ("en", "a b", 2, 45), ("en", "b c", 2, 40), ("en", "a b c", 3, 30)]
    spark.createDataFrame(rows, "lang string, phrase string, words int, f long").write.parquet(f"{tmp_path}/known")
    got = collocations.scored(spark.read.parquet(f"{tmp_path}/known"))
    assert {r["phrase"]: (r["a"], r["l"], r["r"]) for r in got.collect()} == {"a b": (45, 50, 60), "b c": (40, 60, 40), "a b c": (30, 50, 40)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_multikey_quicksort():
    draw = np.random.default_rng(4)
    keys = [draw.integers(0, 4, 500) for _ in range(4)]
    keys[2][draw.random(500) < 0.3] = -1
    keys[3][keys[2] < 0] = -1
    weight = draw.integers(1, 5, 500)
    want = collections.Counter()
    for i in range(500):
        for d in range(1, 5):
            if keys[d - 1][i] >= 0:
                want[tuple(int(k[i]) for k in keys[:d])] += int(weight[i])
    got = {tuple(int(k[p]) for k in keys[:d]): n for d, p, n in collocations.multikey_quicksort(keys, weight, 20)}
    assert got == {k: n for k, n in want.items() if n >= 20}


def test_nothing(spark):
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [(None, None), ("", "en")])).count() == 0
