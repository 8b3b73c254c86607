from __future__ import annotations

import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import bpe, tokens
from tidelog.llm.tokens import BYTE_BPE

VOCABULARY = bpe.Vocabulary.load(BYTE_BPE)
ENCODER = bpe.Encoder(VOCABULARY)
REFERENCE = tiktoken.Encoding("reference", pat_str=bpe.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})

HARD = [
    "", " ", "  ", "\n", " \n ", "a  b", "a \n\n  b", "tab\t\tx", "x \t y", "don't I'LL we've", "\xa0a\xa0 b", " end ", "a\r\n\r\nb",
    "日本語のテキスト。 中文", "🙂🙂 👩‍🔬", "ﬁle é é", "\x1c\x1d a\x85b", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "-" * 300, "=" * 77 + "\n", "0123456789" * 9,
    "٣٤٥ ½ ²", "<|endoftext|>", "　wide　", "a.b,c;d", "'s 's's", "  ", "x" * 5000, " " * 3000 + "y",
]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)
    assert ENCODER.count(text) == len(ENCODER.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t's1\xa0é.", max_size=60))
def test_white_space(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=20), st.integers(0, 40), st.integers(0, 40))
def test_prefixes_appends_and_edits(data, more, a, b):
    def merged(x: bytes) -> list[int]:
        parts = [bytes([c]) for c in x]
        while True:
            ranks = [VOCABULARY.ranks.get(p + q, 1 << 60) for p, q in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 1 << 60:
                return [VOCABULARY.ranks[p] for p in parts]
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    p = bpe.Prefixes(VOCABULARY, data)
    assert all(p.ids(n) == merged(data[:n]) for n in range(len(data) + 1))
    p.append(more)
    assert p.ids() == merged(data + more)
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    p.replace(a, b, more)
    assert p.data == (data + more)[:a] + more + (data + more)[b:]
    assert p.ids() == merged(p.data)


TEXT = st.text(alphabet="ab \n\t's1\xa0é.", max_size=30)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), TEXT), max_size=4), TEXT)
def test_a_document_that_is_edited_and_grows(text, edits, more):
    d = bpe.Document(ENCODER, text)
    for a, b, new in edits:
        a, b = sorted((min(a, len(text)), min(b, len(text))))
        text = text[:a] + new + text[b:]
        d.replace(a, b, new)
        assert d.text == text and d.ids() == REFERENCE.encode_ordinary(text)
    d.append(more)
    assert d.ids() == REFERENCE.encode_ordinary(text + more)


def test_an_edit_redoes_little():
    text = "one two three\n" * 1000
    d = bpe.Document(ENCODER, text)
    assert d.replace(7000, 7002, " xx ") < 9 and d.append("end") < 5
    assert d.ids() == REFERENCE.encode_ordinary(text[:7000] + " xx " + text[7002:] + "end")


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_REMEMBERED", 5)
    e = bpe.Encoder(VOCABULARY)
    r = random.Random(0)
    for _ in range(50):
        t = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(9))
        assert e.encode(t) == REFERENCE.encode_ordinary(t)
    assert len(e.chunks) <= 5 and len(e.chunks.pieces) <= 5


def test_operator(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.ids for r in tokens.encoded(docs, "doc_id", "text").collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got == {i: REFERENCE.encode_ordinary(t) if t else [] for i, t in texts.items()}
    assert any(t is None for t in texts.values())
    counts = {r.doc_id: r.n_tokens for r in tokens.counted(docs, "doc_id", "text").collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokens.encoded(docs.limit(0), "doc_id", "text").count() == 0
    other = spark.createDataFrame([(None, "a b", 1), (2, None, 2)], "ids long, n_tokens string, text int")
    assert [(r.ids, r.x) for r in tokens.encoded(other, "ids", "n_tokens", "x").collect()] == [(None, [64, 275]), (2, [])]
