from __future__ import annotations

import base64
import quopri
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import mail, queries, toxicity
from tidelog.llm.toxicity import THRESHOLD

BAD = "You are a complete idiot, Mika Tarvo, and everyone knows it."
GOOD = "The server in the cellar answered in 12 ms, thank you."


@pytest.fixture(scope="module")
def labelled(spark, small):
    return toxicity.labelled_sample(spark.read.parquet(f"{small}/review_snippets.parquet"), "snippet", "category")


@pytest.fixture(scope="module")
def model(labelled):
    return toxicity.fit(labelled)


@pytest.fixture(scope="module")
def scorer(model):
    return toxicity.Scorer(model)


def wrapped(text: str) -> list[str]:
    head = "From: a@b.example\nSubject: hello\n"
    utf8 = text.encode()
    return [
        head + "\n" + text,
        head + "\n> " + text.replace(" ", "\n> ", 3),
        head + "Content-Transfer-Encoding: base64\n\n" + base64.encodebytes(utf8).decode(),
        head + "Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring(utf8).decode(),
        f"Subject: =?utf-8?B?{base64.b64encode(utf8).decode()}?=\n\nhello",
        head + "Content-Type: text/html\n\n<html><body><p>" + text.replace("o", "<b>o</b>").replace("e", "&#101;") + "</p></body></html>",
        (head + "\n" + text).replace("\n", "\r\n"),
        "\x00\x01 " + text.upper(),
    ]


def test_found_in_any_part(scorer):
    for t in wrapped(BAD):
        assert scorer.scores([t])[0] >= THRESHOLD, t
    for t in wrapped(GOOD):
        assert scorer.scores([t])[0] < THRESHOLD, t


@pytest.mark.parametrize("word", ["i d i o t", "i.d.i.o.t", "1d10t", "idi​ot", "іdіоt", "ｉｄｉｏｔ", "i̶d̶i̶o̶t̶", "idiooot", "iidot", "id**t", "I-D-I-O-T"])
def test_spelling_tricks(scorer, word):
    assert scorer.scores([BAD.replace("idiot", word)])[0] >= THRESHOLD


@pytest.mark.parametrize("text", ["Kill the child process and restart the node.", "The kennel has one bitch and five pups.", "The filter blocks words like whore and slut.", "Damn, the heater jams again, I hate that thing.", "The breast cancer screening is on Monday."])
def test_other_senses(scorer, text):
    assert scorer.scores([text])[0] < THRESHOLD


def test_held_out_accuracy(labelled):
    rows = sorted({r for r in labelled if r[1] in (*toxicity.TOXIC_CATEGORIES, "none")})
    hit = wrong = total = flagged = 0
    for k in range(4):
        held = [r for i, r in enumerate(rows) if i % 4 == k]
        s = toxicity.Scorer(toxicity.fit([r for i, r in enumerate(rows) if i % 4 != k])).scores([t for t, _ in held])
        for (_, c), x in zip(held, s, strict=True):
            bad = c != "none"
            total += bad
            flagged += x >= THRESHOLD
            hit += bad and x >= THRESHOLD
            wrong += not bad and x >= THRESHOLD
    # Some verdicts are wrong, so neither can be complete.
    assert hit / total > 0.9 and wrong / flagged < 0.1, (hit, total, wrong, flagged)


def test_probabilities_are_positive_and_ratios_bounded(model):
    ids = np.random.default_rng(0).integers(0, model.words.size, 5000)
    r = model.ratios(ids)
    assert np.isfinite(r).all() and r.max() <= toxicity.MOST_SAID and r.min() >= -toxicity.MOST_DENIED


def test_each_class_is_a_distribution(model):
    r = np.random.default_rng(3)
    v = model.words.size
    seen = model.three.contexts[r.integers(0, len(model.three.contexts), 40)]
    a = np.concatenate([seen // v, r.integers(0, v, 20)])
    b = np.concatenate([seen % v, r.integers(0, v, 20)])
    every = np.arange(v)
    for x, y in zip(a, b):
        p = model.probabilities(np.full(v, x), np.full(v, y), every)
        assert (p > 0).all() and p.sum(axis=1) == pytest.approx([1.0, 1.0])


@pytest.mark.parametrize("marker", ["only a d", "those ", "es un imb", "ferme ta", "du bist ein", "uns v"])
def test_forms_that_no_row_shows(labelled, marker):
    """All rows of a form are left out of training; most of them are found by what other rows and the seeds say."""
    toxic = {r for r in labelled if r[1] in toxicity.TOXIC_CATEGORIES}
    held = sorted(t for t, _ in toxic if marker in mail.readable(t).lower())
    assert held
    scorer = toxicity.Scorer(toxicity.fit([r for r in labelled if r[0] not in held], folds=2))
    assert (scorer.scores(held) >= THRESHOLD).mean() >= 0.5


def test_background_is_bounded_and_plain(spark, small, model):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n, rows = toxicity.background(docs, "doc_id", "text", model, most_texts=40, most_parts=300)
    assert 0 < n <= 40 and 0 < len(rows) <= 300 and all(0 < len(ids) <= toxicity.PIECE for ids, *_ in rows)
    assert (n, rows) == toxicity.background(docs.repartition(7), "doc_id", "text", model, most_texts=40, most_parts=300)
    wide = toxicity.with_background(model, n, rows)
    assert len(wide.ordinary) - len(model.ordinary) == len(rows)
    odd = [((9,), True, 1, THRESHOLD), ((9,), False, 1, 0.0), ((9,), False, n, THRESHOLD), ((9,), True, n, 9.0)]
    assert [toxicity._is_plain(n, *kind) for _, *kind in odd] == [False, False, True, False]
    assert toxicity.background(docs.limit(0), "doc_id", "text", model) == (0, [])
    assert len(toxicity.with_background(model, 0, []).ordinary) == len(model.ordinary)


def parts_by_a_loop(scorer, texts):
    """(ids, is a sentence) to the texts that have it, and its score, by the definition."""
    def score(ids):
        return scorer.model.best(np.array([*ids, 0]), np.array([0, len(ids) + 1]))[0]

    n, scores = Counter(), {}
    for t in texts:
        found, sentence = set(), []
        for i in [*scorer.ids(mail.readable(t)).tolist(), 0]:
            if i and len(sentence) < toxicity.PIECE:
                sentence.append(i)
                continue
            if any(x >= toxicity.RESERVED for x in sentence):
                found.add((tuple(sentence), True))
            sentence = [i] if i else []
        for ids, _ in list(found):
            if score(ids) >= toxicity.PLAIN:
                found |= {(ids[i : i + toxicity.WINDOW], False) for i in range(max(1, len(ids) - toxicity.WINDOW + 1))}
        n.update(found)
        scores.update((p, score(p[0])) for p in found if p not in scores)
    return {p: (k, scores[p]) for p, k in n.items()}


def test_background_is_of_all_texts(spark, scorer, model):
    """More texts than any sample that was once taken; each has a sentence that no other has."""
    words = [w for w in model.words.words[model.words.first_word - toxicity.RESERVED :] if w.isascii() and w.isalpha() and w not in model.words.strong]
    texts = [f"The {a} and {b} of the archive." for a in words[:80] for b in words[:40] if a != b]
    texts = [t for t, s in zip(texts, scorer.scores(texts)) if s < toxicity.PLAIN]
    assert len(texts) > 2_000
    df = spark.createDataFrame([*enumerate([*texts, *texts[:500], None])], "k long, t string")
    n, parts = toxicity.background(df, "k", "t", model)
    sentences = {tuple(scorer.ids(t)[:-1].tolist()) for t in texts}
    assert n == len(texts) and {p for p, *_ in parts} == sentences and len(parts) == len(sentences) == len(texts)
    more = toxicity.background_counts(toxicity.read(df.repartition(5), "k", "t", model), model)
    expected = Counter(x for s in sentences for x in zip((0, 0, *s), (0, *s, 0), (*s, 0)))
    assert more == expected


def test_counts_of_trigrams_are_those_of_the_parts(spark, small, scorer, model):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.text for r in docs.select("text").collect() if r.text is not None}
    n, parts = toxicity.background(docs, "doc_id", "text", model)
    loop = {p: x for p, x in parts_by_a_loop(scorer, texts).items() if toxicity._is_plain(len(texts), p[1], *x)}
    assert n == len(texts) and {(p, sentence): (k, s) for p, sentence, k, s in parts} == loop
    assert {sentence for _, sentence, *_ in parts} == {True, False}
    rows = toxicity.with_background(model, n, parts)
    counted = toxicity.with_counts(model, toxicity.background_counts(toxicity.read(docs.union(docs), "doc_id", "text", model), model))
    assert counted.whole == rows.whole and (counted.one == rows.one).all() and (counted.base == rows.base).all()
    for a, b in ((counted.two, rows.two), (counted.three, rows.three)):
        assert all((getattr(a, x) == getattr(b, x)).all() for x in ("contexts", "left", "unseen", "keys", "mass"))


def test_company_of_ordinary_text_says_nothing_for_toxic(model):
    """However often ordinary text has had two numbers and ``the``: other words after two numbers say no more than before."""
    toxic = {x for ids, _ in model.toxic for x in zip(ids, ids[1:])}
    assert (toxicity.NUMBER, toxicity.NUMBER) not in toxic
    words = np.setdiff1d(np.arange(toxicity.RESERVED, model.words.size), [model.words.ids["the"]])

    def ratios(n):
        m = toxicity.with_counts(model, {(toxicity.NUMBER, toxicity.NUMBER, model.words.ids["the"]): n})
        seen = [w for (*k, w) in toxicity._counts(model.ordinary, {})[0] if k == [toxicity.NUMBER, toxicity.NUMBER]]
        w = np.setdiff1d(words, seen)
        p = m.probabilities(np.full(len(w), toxicity.NUMBER), np.full(len(w), toxicity.NUMBER), w)
        return np.log(p[0]) - np.log(p[1])

    assert ratios(100_000) == pytest.approx(ratios(1))


def test_what_many_texts_have_counts_as_often(spark, scorer, model):
    """Else the more sentences an archive has that one text each has, the less a common one would weigh."""
    common, own = "The night shift roster is here.", [f"The server {w} answered." for w in ("in the cellar", "at night", "again")]
    assert (scorer.scores([common, *own]) < toxicity.PLAIN).all()
    df = spark.createDataFrame([(i, f"{common} {own[i % 3]} {i}") for i in range(60)] + [(99, f"{common} {own[0]} 0")], "k long, t string")
    more = toxicity.background_counts(toxicity.read(df.repartition(3), "k", "t", model), model)
    n, parts = toxicity.background(df, "k", "t", model)
    assert n == 60 and {k for *_, k, _ in parts} == {60, 20}
    expected = Counter()
    for ids, _, texts, _ in parts:
        for x in zip((0, 0, *ids), (0, *ids, 0), (*ids, 0)):
            expected[x] += texts
    assert more == expected and more[0, 0, model.words.ids["the"]] == 120


def test_all_labelled_rows_train(spark):
    rows = [(f"row {i}", "none") for i in range(20_100)]
    df = spark.createDataFrame([*rows, (None, "none"), ("row", None)], "t string, c string")
    assert sorted(toxicity.labelled_sample(df, "t", "c")) == sorted(rows)
    assert len(toxicity.labelled_sample(df, "t", "c", max_labelled=30)) == 30


def test_best_window_agrees_with_a_loop(model):
    r = np.random.default_rng(1)
    texts = [r.integers(0, 60, n) for n in (0, 1, 3, 7, 30, 200)]
    ids, offsets = [], [0]
    for t in texts:
        ids += [*t, 0]
        offsets.append(len(ids))
    got = model.best(np.array(ids), np.array(offsets))
    for k, t in enumerate(texts):
        ratios = model.ratios(np.array(ids))[offsets[k] : offsets[k + 1]]
        best, sentence = 0.0, []
        for i, x in enumerate([*t, 0]):
            if x == 0:
                sentence = []
                continue
            sentence.append(ratios[i])
            last = [*t, 0][i + 1] == 0
            if last or len(sentence) >= toxicity.WINDOW:
                w = sentence[-toxicity.WINDOW :]
                best = max(best, sum(w) / max(len(w), toxicity.SHORTEST))
        assert got[k] == pytest.approx(best)


def test_nulls_empty_and_long(scorer):
    s = scorer.scores([None, "", "  \n\n ", "word " * 200_000 + BAD, "x" * 300_000])
    assert s[:3].tolist() == [0.0, 0.0, 0.0] and s[3] >= THRESHOLD and s[4] == 0.0
    assert len(scorer.scores([])) == 0


def test_readable_undoes_wrong_decoding():
    assert mail.readable("imbÃ©cile Ã\xa0 la") == "imbécile à la"
    assert mail.readable(None) == ""
    assert "aGVsbG8" in mail.readable("Content-Transfer-Encoding: base64\n\naGVsbG8!")


@pytest.mark.parametrize("data", [
    ("Η συνάντηση. " + BAD + "\n\n").encode() + ("Η αναφορά δεν έφτασε. " * 20).encode().decode("latin-1").encode(),
    b"\x00\x01\x02\x90\xff" * 2000 + b"\n\n" + BAD.encode() + b"\n\n" + b"\x00\x01\x02\x90\xff" * 2000,
    (BAD + "\x01" * 40).encode("cp1252"),
])
@pytest.mark.parametrize("kind", ["text/plain; charset=utf-8", "application/octet-stream"])
def test_no_attached_part_is_left_out(scorer, data, kind):
    part = f"hello\n\n--b\nContent-Type: {kind}\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(data).decode() + "\n--b--\n"
    assert scorer.scores([part])[0] >= THRESHOLD


def test_declared_charset_and_words_like_base64(scorer):
    head = "Content-Type: text/plain;\n charset=\"{}\"\nContent-Transfer-Encoding: base64\n\n"
    for charset in ("utf-16", "utf-16-le"):
        assert BAD in mail.readable(head.format(charset) + base64.encodebytes(BAD.encode(charset)).decode())
    russian = "Ты полный идиот"
    assert russian in mail.readable(head.format("koi8-r") + base64.encodebytes(russian.encode("koi8-r")).decode())
    assert "Donaudampfschifffahrtsgesellschaft" in mail.readable("base64\n\nDonaudampfschifffahrtsgesellschaft\n")
    assert mail.readable("Η αναφορά".encode().decode("latin-1")) == "Η αναφορά"


@pytest.mark.parametrize("text", ["Send it by noon. Idiot! Regards", "Moron.", "See below.\n\n1d10t\n\nRegards", "Danke. Arschloch!", "Hello. Idiooot!!! Bye."])
def test_a_word_may_be_a_sentence(scorer, text):
    assert scorer.scores([text])[0] >= THRESHOLD
    for plain in ("Stop.", "Go!", "Those.", "Thanks! Regards", "The filter lists the word idiot twice."):
        assert scorer.scores([plain])[0] < THRESHOLD, plain


def test_one_word_can_say_enough_for_a_window(model, monkeypatch):
    known, plain = model.words.ids["idiot"], model.words.ids["the"]
    monkeypatch.setattr(model, "ratios", lambda ids, most=toxicity.MOST_SAID: np.where(ids == known, most, 0.0))
    ids = np.array([plain, plain, known, plain, plain, 0])
    assert model.best(ids, np.array([0, len(ids)]))[0] >= THRESHOLD


@pytest.mark.parametrize("word", ["idi" + "o" * 40 + "t", "i" * 5_000 + "diot", "1d1" + "0" * 60 + "t", "іdі" + "о" * 50 + "t"])
def test_stretched_words_of_any_length(scorer, word):
    assert scorer.scores([BAD.replace("idiot", word)])[0] >= THRESHOLD


def test_queries(spark, small):
    scores = queries.p9_scores(spark, small).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in scores) == sorted(ids)
    found = {r.doc_id for r in queries.p9_found(spark, small).collect()}
    assert found == {r.doc_id for r in scores if r.flagged} == {r.doc_id for r in scores if r.score >= THRESHOLD}
    rates = queries.p9_source_rates(spark, small).collect()
    assert sum(r.n_texts for r in rates) == len(ids) and sum(r.n_flagged for r in rates) == len(found)
