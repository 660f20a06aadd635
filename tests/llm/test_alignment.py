"""Tokenizer alignment against the tokenizers' own libraries and all links in plain Python."""
import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortspark.llm import alignment

from .conftest import frame

TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b   c ", "it's  we'll\n\n x\t y\r\n", "é ﬁ ½ 日本語🙂", "x▁y", "▁", "<s></s><unk><|endoftext|>", "\x00 \x1c\x85 　 ",
         "1234 5 6.7!?", "  lead", "\n", "ab" * 300 + " " * 50 + "cd", "naïve ﬀ ™ ﷽"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(alignment.VOCABULARY_A, alignment.VOCABULARY_B)


@pytest.fixture(scope="module")
def reference():
    a = Tokenizer.from_file(alignment.VOCABULARY_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.VOCABULARY_B)
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), (lambda t: b.encode(t, num_threads=1))


def plain(aligner, reference, text):
    """(ids of A, ids of B, linked pairs, printed groups), every pair of tokens compared."""
    if not text:
        return [], [], [], ""
    a, b = (side(text) for side in reference)
    if any(b"".join(side.bytes[i] for i in ids) != b" " + text.encode() for side, ids in ((aligner.a, a), (aligner.b, b))):
        return [], [], [], ""
    ends = [np.cumsum([len(side.bytes[i]) for i in ids]).tolist() for side, ids in ((aligner.a, a), (aligner.b, b))]
    links = [(i, j) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if x == y]
    groups, p, q = [], 0, 0
    for i, j in links:
        groups.append(",".join(map(str, a[p:i + 1])) + "|" + ",".join(map(str, b[q:j + 1])))
        p, q = i + 1, j + 1
    return a, b, [(a[i], b[j]) for i, j in links], ";".join(groups)


def expected(aligner, reference, rows):
    made = [(i, *plain(aligner, reference, t)) for i, t in rows]
    count = collections.Counter(p for m in made for p in m[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, a, b, links, groups in made:
        out.append((i, len(a), len(b), len(links), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if links else ""))
    return sorted(out, key=repr), count


FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("links, dense", [(3_000_000, 4_096), (300, 3)])
def test_against_all_pairs(spark, monkeypatch, aligner, reference, corpus, links, dense):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", links)
    monkeypatch.setattr(alignment, "DENSE", dense)
    rows = [(i, t) for i, t, _ in corpus if len(t or "") < 3_000] + list(enumerate(TEXTS, 600)) + [(700 + i, "the the of") for i in range(40)] + [(None, "the end"), (None, "the end")]
    made = alignment.aligned(frame(spark, [(i, t, "s") for i, t in rows]).repartition(3))
    want, count = expected(aligner, reference, rows)
    assert sorted((tuple(r[c] for c in FIELDS) for r in made.collect()), key=repr) == want
    encoded = alignment.encoded(frame(spark, [(i, t, "s") for i, t in rows]).repartition(3)).where("pair is not null")
    pairs = {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in alignment.pair_counts(encoded).collect()}
    documents, of_b = collections.Counter(), collections.Counter()
    for _, t in rows:
        held = set(plain(aligner, reference, t)[2])
        documents.update(held)
        of_b.update({b for _, b in held})
    assert pairs == {p: (documents[p], n) for p, n in count.items()}
    assert {r["b"]: r["n_docs"] for r in alignment.documents_of_b(encoded).collect()} == dict(of_b)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab 's\n\té.1　🙂\x00xll"), max_size=40))
def test_encodings_are_those_of_the_libraries(aligner, reference, text):
    assert aligner.a.encode(" " + text).tolist() == reference[0](text)
    assert list(aligner.b.encode(text)) == (reference[1](text) if text else [aligner.b.space])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([" ", "\n", "\t ", "　", "a"]), st.integers(1, 12)), max_size=8), st.sampled_from(["", "x", "'s", "1"]))
def test_long_runs_are_cut_where_the_pattern_cuts(aligner, reference, parts, tail):
    text = "".join(c * n for c, n in parts) + tail
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(alignment, "LONG_RUN", 3)
        assert alignment.encode_cut(aligner.a.encoding, " " + text, alignment.long_runs(3)).tolist() == reference[0](text)


def test_very_long_texts(spark, aligner):
    draw = random.Random(1)
    texts = [" " * 1_000_000, "\n" * 1_000_000 + "x", "a" * 300_000, "ab " * 100_000, "".join(draw.choice("ab é1") for _ in range(200_000))]
    got = {r["doc_id"]: r for r in alignment.aligned(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert 0 < got[i]["n_links"] == got[i]["n_groups"] <= min(got[i]["n_a"], got[i]["n_b"])
        assert b"".join(aligner.a.bytes[k] for k in aligner.a.encode(" " + t).tolist()) == b" " + t.encode()


def test_nothing(spark):
    assert alignment.aligned(frame(spark, [])).count() == 0
    assert [tuple(r) for r in alignment.aligned(frame(spark, [(None, None, "s"), (1, "", "s")])).orderBy("doc_id").collect()] == [(None, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]


def test_bitmaps():
    docs = np.concatenate([np.arange(0, 60_000, 3), [7], np.arange(5)]).astype(np.int32)
    made = alignment.bitmaps(docs, np.array([0, 20_000, 20_001]))
    assert [alignment.members(x.as_py()).tolist() for x in made] == [list(range(0, 60_000, 3)), [7], list(range(5))]
    assert [len(x.as_py()) for x in made] == [8_192, 2, 10]


def test_plain_ids_are_those_of_the_general_path():
    from cohortspark.llm import packing
    tokenizer = packing.Tokenizer(packing.VOCABULARY)
    tokenizer.encoding.encode_to_numpy, general = None, tokenizer.encoding.encode_to_numpy  # the slower path is not taken
    for text in ("", "a", "The word's 12 é ñ <|endoftext|> 漢字 \U0001f600", "x" * 500, " \n\t " * 40 + "end", "don't " * 50):
        got = np.frombuffer(tokenizer.encode(text), tokenizer.kind)
        assert got.tolist() == general(text).tolist()
