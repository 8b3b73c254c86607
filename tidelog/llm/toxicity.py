"""Abusive, hateful or sexual content, by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney trigram models over words, one of sentences judged toxic and one of the others, share the
counts of their lowest order and the mass that each context leaves to lower orders: a rare word has nearly the same
probability in both and says little, a word of one class says much, and in the company in which the other class uses it, it
says the opposite. Each is a distribution after any context. The score of a text is the
greatest length-normalised log-likelihood ratio over its sentences, or over ``WINDOW`` words of a longer one, in nats a
word. Every word of every text is scored. A short sentence that toxic training rows hold whole, and the others don't, is toxic.

Words are read through spelling tricks: unseen marks, look-alike letters, digits for letters, letters set apart,
repeated, swapped or starred out. Only a word that no model knows is changed, and only into one that a model knows.

All labelled rows train the models, and the plain sentences of all texts to be scored join the ordinary ones, as counts. Texts
are read once: their words' ids, which depend on the labelled rows alone, serve both the counts and the scores. Verdicts may
be wrong: rows that models of the other rows contradict clearly are left out.

Null, empty and blank texts score 0 and aren't flagged.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import seeds
from tidelog.llm.mail import readable

TOXIC_CATEGORIES = ("abusive", "hateful", "sexual")
#: The most words of a part of the background.
PIECE = 25
#: A sentence that scores below PLAIN, or what stands in this share of the texts and in so many, is ordinary.
PLAIN, COMMON, COMMON_TEXTS = 0.5, 0.005, 8
WINDOW, SHORTEST = 5, 4
THRESHOLD = 1.3
#: Discounts of bigrams and trigrams, and of single words.
DISCOUNT, LOW_DISCOUNT = 0.75, 0.3
#: No word says more than this for or against, in nats; plain words around an insult don't undo it.
MOST_SAID, MOST_DENIED = 5.0, 2.0
SEED_WEIGHT = 1
CONTRADICTED = 0.6
NAME_ROWS = 8
MOST_REMEMBERED = 300_000
ROWS = 256

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+(?:[*@$]+[^\W_]+)*|[.!?…。！？]+(?=\s|$|[㐀-鿿])|\x01")

# Letters of other scripts that look like Latin ones, and digits and signs read as letters.
_LOOKALIKE = str.maketrans("абвгдеёзијкмнорстухѕіјԁԛԝһӏαβεικνορτυχ", "abbrdeezijkmhopctyxsijdqwhlabeiknoptux")
_LEET = str.maketrans("013456789@$", "oleasgtbgas")
_LEET_I = str.maketrans("013456789@$", "oieasgtbgas")

END, UNKNOWN, NUMBER, LETTER = 0, 1, 2, 3
#: Ids up to here are no words; then come single digits, single letters, and words.
RESERVED = 4
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
BLANK_LINE = "\x01"


def split(text: str) -> list[str]:
    """Words and ends of sentences of a lower-case text."""
    return _TOKEN.findall(text)


def _is_end(token: str) -> bool:
    return token[0] in ".!?…。！？\x01"


def _squeeze(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1", w)


class Words:
    """Vocabulary, and how a written word is read."""

    def __init__(self, words: Sequence[str], strong: Iterable[str]) -> None:
        """``strong``: words of the toxic class, the only ones that swapped or starred letters are read as."""
        singles = sorted({*DIGITS, *LETTERS, *(w for w in words if len(w) == 1)})
        self.words = singles + sorted(w for w in words if len(w) > 1)
        self.first_word = RESERVED + len(singles)
        self.ids = {w: i + RESERVED for i, w in enumerate(self.words)}
        self.size = RESERVED + len(self.words)
        self.squeezed: dict[str, int] = {}
        for w in sorted(strong):
            if len(w) >= 4 and w in self.ids:
                self.squeezed.setdefault(_squeeze(w), self.ids[w])
        self.strong = [w for w in sorted(strong) if len(w) >= 4 and w in self.ids]
        self.by_shape = defaultdict(list)
        self.swapped: dict[str, int] = {}
        for w in self.strong:
            self.by_shape[len(w)].append(w)
            for i in range(len(w) - 1):
                s = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
                if s not in self.ids:
                    self.swapped.setdefault(s, self.ids[w])

    def read(self, token: str) -> int:
        known = self.ids.get(token)
        if known is not None:
            return known
        if _is_end(token):
            return END
        if len(token) == 1:
            return NUMBER if token.isdigit() else LETTER
        if token.isdigit():
            return NUMBER
        if not token.isascii():
            token = unicodedata.normalize("NFKC", token).lower()
            if token in self.ids:
                return self.ids[token]
            latin = token.translate(_LOOKALIKE)
            if latin in self.ids:
                return self.ids[latin]
            token = latin if any("a" <= c <= "z" for c in latin) else token
        return self._respell(token)

    def _respell(self, token: str) -> int:
        forms = [token]
        if any(c in "0123456789@$" for c in token) and any(c.isalpha() for c in token):
            forms += [token.translate(_LEET_I), token.translate(_LEET)]
        for f in forms:
            found = self.ids.get(f) or self.swapped.get(f)
            if found:
                return found
        for f in forms:
            if "*" in f:
                starred = self._starred(f)
                if starred:
                    return starred
            elif len(f) >= 4 and (s := _squeeze(f)) in self.squeezed and (s != f or f != token):
                return self.squeezed[s]
        if any(c.isdigit() for c in token) and sum(c.isalpha() for c in token) < 2:
            return NUMBER
        return UNKNOWN

    def _starred(self, token: str) -> int | None:
        """A strong word of the same length that agrees in all letters shown, two of them at least."""
        shown = [(i, c) for i, c in enumerate(token) if c != "*"]
        if len(shown) < 2:
            return None
        for w in self.by_shape.get(len(token), ()):
            if all(w[i] == c for i, c in shown):
                return self.ids[w]
        return None


def _counts(sentences: list[tuple[list[int], int]], more: Mapping[tuple[int, int, int], int]) -> tuple[Counter, Counter, Counter]:
    """Weighted trigram counts, those of ``more`` included, and the distinct left contexts of bigrams and of words."""
    three: Counter = Counter(more)
    for ids, weight in sentences:
        padded = [END, END, *ids, END]
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            three[a, b, c] += weight
    # A word that no model knows is no company: what comes after it starts anew.
    two = Counter((b, c) for _, b, c in three if b != UNKNOWN)
    one = Counter(c for _, c in {(b, c) for _, b, c in three})
    three = Counter({k: n for k, n in three.items() if UNKNOWN not in k[:2]})
    return three, two, one


def _grouped(counts: dict) -> dict[int, dict[int, float]]:
    """Counts of (..., context, word) by context."""
    out: dict = defaultdict(dict)
    for (*context, word), n in counts.items():
        out[tuple(context) if len(context) > 1 else context[0]][word] = n
    return out


class _Order:
    """One order of both models: for each context that a class has seen, the mass it leaves to the next lower order.

    That mass is Kneser-Ney's for the counts of both classes together, the same in both models. A class spreads the rest as its
    own counts stand. A class that hasn't seen the context spreads it otherwise: the ordinary one as the shared counts of single
    words, the toxic one to the unknown word, which isn't scored. So each model's probabilities after any context sum to 1, and
    what company only ordinary text has kept says nothing for toxic, however often it was met: a word that neither has seen
    after it says what it says without it.
    """

    def __init__(self, per: Sequence[dict], v: int, base: np.ndarray, context_key) -> None:
        own = [_grouped(c) for c in per]
        contexts = sorted({*own[0], *own[1]})
        self.contexts = np.array(sorted(context_key(c) for c in contexts), dtype=np.int64)
        at = {int(k): i for i, k in enumerate(self.contexts)}
        self.left = np.ones(len(contexts) + 1)
        self.unseen = np.zeros((2, len(contexts) + 1))
        self.spread = np.stack([np.arange(v) == UNKNOWN, base])
        keys: list[int] = []
        mass: list[list[float]] = []
        for c in contexts:
            i = at[context_key(c)]
            a, b = own[0].get(c, {}), own[1].get(c, {})
            words = sorted({*a, *b})
            total = sum(a.values()) + sum(b.values())
            self.left[i] = min(1.0, DISCOUNT * len(words) / total)
            for k, x in enumerate((a, b)):
                self.unseen[k, i] = 0.0 if x else 1.0 - self.left[i]
            sums = sum(a.values()), sum(b.values())
            for w in words:
                keys.append(i * v + w)
                mass.append([(1.0 - self.left[i]) * (x.get(w, 0.0) / n if n else spread[w]) for x, n, spread in zip((a, b), sums, self.spread)])
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.mass = np.array(mass, dtype=np.float64).reshape(-1, 2)[order].T.copy()
        self.v = v

    def place(self, context: np.ndarray) -> np.ndarray:
        """The number of each context, that of none where neither class has seen it."""
        none = len(self.contexts)
        if not none:
            return np.zeros(len(context), dtype=np.int64)
        i = np.minimum(np.searchsorted(self.contexts, context), none - 1)
        return np.where(self.contexts[i] == context, i, none)

    def over(self, lower: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """This order's probabilities (2, n) over the ``lower`` order's."""
        out = lower * self.left[at] + self.unseen[:, at] * self.spread[:, ids]
        if len(self.keys):
            key = at * self.v + ids
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero((self.keys[i] == key) & (at < len(self.contexts)))
            i = i[hit]
            # What a class without the context gives to a word is in its mass already.
            out[:, hit] += self.mass[:, i] - self.unseen[:, at[hit]] * self.spread[:, ids[hit]]
        return out


@dataclass
class Model:
    """Log-probabilities of both classes, every order by key: as large as the distinct trigrams of known words."""

    words: Words
    toxic: list[tuple[list[int], int]]
    ordinary: list[tuple[list[int], int]]
    #: Trigrams of ordinary text besides the rows.
    more: Mapping[tuple[int, int, int], int] = field(default_factory=dict)
    ready: bool = field(default=False)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __getstate__(self) -> dict:
        """Once prepared, a model is sent without what it was made of."""
        return self.__dict__ | ({"toxic": [], "ordinary": [], "more": {}} if self.ready else {})

    def prepare(self) -> Model:
        if self.ready:
            return self
        v = self.words.size
        strong = {self.words.ids[w] for w in self.words.strong}
        short = [{tuple(ids) for ids, _ in rows if len(ids) < SHORTEST} for rows in (self.toxic, self.ordinary)]
        # Words that are abuse as a whole sentence are no rows: they'd move the chances of all other sentences.
        short[0] |= {(self.words.ids[w],) for w in seeds.ALONE if w in self.words.ids}
        self.whole = {s for s in short[0] - short[1] if strong.intersection(s)}
        self.ending = np.zeros(v, dtype=bool)
        self.ending[[s[-1] for s in self.whole]] = True
        self.most = np.full(v, MOST_SAID)
        # Alone among neutral words, only a word that is abuse by itself may say enough for a whole window.
        self.most[[s[0] for s in self.whole if len(s) == 1]] = THRESHOLD * WINDOW
        per = [_counts(self.toxic, {}), _counts(self.ordinary, self.more)]
        shared = Counter()
        for _, _, one in per:
            shared.update(one)
        total = max(1, sum(shared.values()))
        self.base = np.full(v, LOW_DISCOUNT * len(shared) / total / v if shared else 1.0 / v)
        for w, n in shared.items():
            self.base[w] += (n - LOW_DISCOUNT) / total
        self.one = np.empty((2, v))
        for k, (_, _, one) in enumerate(per):
            n1 = max(1, sum(one.values()))
            self.one[k] = self.base * (LOW_DISCOUNT * len(one) / n1 if one else 1.0)
            for w, n in one.items():
                self.one[k, w] += (n - LOW_DISCOUNT) / n1
        self.two = _Order([two for _, two, _ in per], v, self.base, lambda b: b)
        self.three = _Order([three for three, _, _ in per], v, self.base, lambda c: c[0] * v + c[1])
        self.ready = True
        return self

    def probabilities(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """(2, n): the chance of word ``c`` after words ``a b``, in the toxic and in the ordinary model."""
        p = self.two.over(self.one[:, c], self.two.place(b), c)
        return self.three.over(p, self.three.place(a * self.words.size + b), c)

    def ratios(self, ids: np.ndarray, most: np.ndarray | float = MOST_SAID) -> np.ndarray:
        """Log-likelihood ratio of each word in its context, at most ``most``; sentences are set apart by END."""
        b = np.concatenate([[END], ids[:-1]]).astype(np.int64)
        a = np.concatenate([[END], b[:-1]])
        a = np.where(b == END, END, a)
        out = np.zeros(len(ids))
        # A word that neither model knows, a number or a lone letter says nothing by itself.
        says = np.flatnonzero(ids >= RESERVED)
        p = self.probabilities(a[says], b[says], ids[says].astype(np.int64))
        out[says] = np.clip(np.log(p[0]) - np.log(p[1]), -MOST_DENIED, most[says] if isinstance(most, np.ndarray) else most)
        return out

    def best(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text (its ids from one offset to the next) the greatest mean ratio of a window within a sentence."""
        n = len(ids)
        out = np.zeros(len(offsets) - 1)
        if not n:
            return out
        sums = np.concatenate([[0.0], np.cumsum(self.ratios(ids, self.most[ids]))])
        place = np.arange(n)
        begin = np.where(ids == END, place + 1, 0)
        begin[offsets[:-1][offsets[:-1] < n]] = np.maximum(begin[offsets[:-1][offsets[:-1] < n]], offsets[:-1][offsets[:-1] < n])
        begin = np.maximum.accumulate(np.concatenate([[0], begin[:-1]]))
        begin = np.maximum(begin, np.repeat(offsets[:-1], np.diff(offsets)))
        start = np.maximum(begin, place - WINDOW + 1)
        mean = (sums[place + 1] - sums[start]) / np.maximum(place + 1 - start, SHORTEST)
        # A window counts when it is full, or is the whole of a sentence.
        ends = np.concatenate([ids[1:] == END, [True]])
        mean = np.where((ids != END) & (ends | (place + 1 - start == WINDOW)), mean, 0.0)
        # Sentences are whole where one begins and ends within SHORTEST - 1 words; few of them have a word of ``whole``.
        for size in range(1, SHORTEST):
            last = np.flatnonzero(self.ending[ids] & ends & (ids != END) & (place + 1 - begin == size))
            for i in last.tolist():
                if tuple(ids[i + 1 - size : i + 1].tolist()) in self.whole:
                    mean[i] = MOST_SAID
        full = np.diff(offsets) > 0
        out[full] = np.maximum.reduceat(mean, offsets[:-1][full])
        # Sums run over a whole batch; rounding keeps a text's score the same in any company.
        return np.round(np.maximum(out, 0.0), 6)


class _Chunks(dict):
    """What stands between white space, to the ids of its words; made when asked for."""

    def __init__(self, words: Words) -> None:
        self.words, self.known = words, {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = []
        for t in split(chunk):
            if t not in self.known:
                if len(self.known) > MOST_REMEMBERED:
                    self.known.clear()
                self.known[t] = self.words.read(t)
            ids.append(self.known[t])
        if len(chunk) <= 24:
            if len(self) > MOST_REMEMBERED:
                self.clear()
            self[chunk] = tuple(ids)
        return tuple(ids)


class Reader:
    """Texts to ids, remembering how words are read."""

    def __init__(self, words: Words) -> None:
        self.words = words
        self.chunks = _Chunks(words)

    def ids(self, text: str) -> np.ndarray:
        text = text.lower()
        if "\r" in text:
            text = text.replace("\r\n", "\n")
        chunks = text.replace("\n\n", f" {BLANK_LINE} ").split()
        ids = np.fromiter(chain.from_iterable(map(self.chunks.__getitem__, chunks)), dtype=np.int64)
        lone = (ids < self.words.first_word) & (ids > LETTER)
        if lone.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], lone.view(np.int8), [0]])))
            for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if hi - lo >= 3:
                    self._join(ids, lo, hi)
            ids = ids[ids >= 0]
            ids[(ids >= RESERVED) & (ids < RESERVED + 10)] = NUMBER
        return ids

    def _join(self, ids: np.ndarray, lo: int, hi: int) -> None:
        """Letters set apart are read as one word; a letter or two before it may be words of their own."""
        letters = [self.words.words[i - RESERVED] for i in ids[lo:hi].tolist()]
        for skip in range(min(3, hi - lo - 2)):
            word = self.words.read("".join(letters[skip:]))
            if word >= self.words.first_word:
                ids[lo + skip] = word
                ids[lo + skip + 1 : hi] = -1
                return


def _joined(texts: Sequence[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Stored ids of texts, each closed by END, in one array, and where each text begins and the last ends."""
    offsets = np.concatenate([[0], np.cumsum([len(t) // kind.itemsize for t in texts], dtype=np.int64)])
    return np.frombuffer(b"".join(texts), dtype=kind).astype(np.int64), offsets


def _cut(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and number of the text of each sentence that has words; longer ones in pieces of ``PIECE`` words."""
    inside = np.concatenate([[False], ids != END, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    pieces = -((begin - end) // PIECE)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = np.repeat(begin, pieces) + PIECE * nth
    hi = np.minimum(lo + PIECE, np.repeat(end, pieces))
    words = np.concatenate([[0], np.cumsum(ids >= RESERVED)])
    keep = words[hi] > words[lo]
    return lo[keep], hi[keep], np.searchsorted(offsets, lo[keep], "right") - 1


class Scorer:
    """Texts to scores."""

    def __init__(self, model: Model) -> None:
        self.model = model.prepare()
        self.words = model.words
        self.ids = Reader(model.words).ids

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        parts, offsets = [], [0]
        for t in texts:
            ids = self.ids(readable(t))
            parts += [ids, np.array([END])]
            offsets.append(offsets[-1] + len(ids) + 1)
        return self.model.best(np.concatenate(parts), np.array(offsets)) if parts else np.zeros(0)


def _sentences(reader: Reader, rows: Iterable[tuple[str, int]]) -> list[tuple[list[int], int]]:
    out = []
    for text, weight in rows:
        ids = [int(i) for i in reader.ids(readable(text)) if i != END]
        if ids:
            out.append((ids, weight))
    return out


def _fit(toxic: list[tuple[str, int]], ordinary: list[tuple[str, int]]) -> Model:
    """Two passes: spelling tricks in the training rows are read with the words that the plain rows have."""
    counts = [Counter(), Counter()]
    names = _names(t for t, _ in (*toxic, *ordinary))
    for k, rows in enumerate((toxic, ordinary)):
        for text, weight in rows:
            for t in set(split(readable(text).lower())):
                if t not in names and not _is_end(t) and not any(c.isdigit() or c in "*@$" for c in t):
                    counts[k][t] += weight
    totals = [max(1, sum(c.values())) for c in counts]
    strong = [w for w, n in counts[0].items() if n / totals[0] > 3 * counts[1][w] / totals[1] and (n > 1 or len(w) > 3)]
    # A word seen once only as an odd spelling of a strong word isn't a word.
    frequent = {w for w in strong if counts[0][w] > 1}
    draft = Words(sorted(frequent), frequent)
    odd = {w for w in {*counts[0], *counts[1]} if w not in frequent and counts[0][w] + counts[1][w] <= 2 and len(w) > 3 and draft.read(w) >= RESERVED}
    vocabulary = sorted({w for c in counts for w in c if w not in odd and w.isascii() | (unicodedata.normalize("NFKC", w) == w)})
    words = Words(sorted({*vocabulary, *seeds.ALONE}), {*(w for w in strong if w not in odd), *seeds.ALONE})
    reader = Reader(words)
    return Model(words, _sentences(reader, toxic), _sentences(reader, ordinary)).prepare()


_NAME = re.compile(r"\b[^\W\d_a-z][^\W\d_]+ [^\W\d_a-z][^\W\d_]+\b")


def _names(texts: Iterable[str]) -> set[str]:
    """Words of two in a row with a capital that occur in few rows, and only so: names of people."""
    texts = [readable(t) for t in texts]
    rows = Counter(w for t in texts for w in {x for x in split(t)})
    pairs = {w for t in texts for m in _NAME.findall(t) for w in m.split()}
    return {w.lower() for w in pairs if rows[w] <= NAME_ROWS and not rows[w.lower()]}


def fit(labelled: Sequence[tuple[str, str]], folds: int = 5) -> Model:
    """A model of (text, category) rows and the seeds. Rows whose verdict models of the other folds contradict are left out.

    It knows ordinary language from these rows only; ``with_counts`` adds the archive's own.
    """
    rows = sorted((t, c in TOXIC_CATEGORIES) for t, c in labelled if t and c in (*TOXIC_CATEGORIES, "none"))
    extra = [[(t, SEED_WEIGHT) for t in x] for x in (seeds.TOXIC, seeds.ORDINARY)]

    def model_of(chosen: list[tuple[str, bool]]) -> Model:
        return _fit([(t, 1) for t, bad in chosen if bad] + extra[0], [(t, 1) for t, bad in chosen if not bad] + extra[1])

    kept = []
    for k in range(folds):
        scorer = Scorer(model_of([r for i, r in enumerate(rows) if i % folds != k]))
        held = [r for i, r in enumerate(rows) if i % folds == k]
        for r, s in zip(held, scorer.scores([t for t, _ in held]), strict=True):
            if (s < CONTRADICTED / 2) if r[1] else (s > THRESHOLD + CONTRADICTED):
                continue
            kept.append(r)
    return model_of(kept)


def labelled_sample(snippets: DataFrame, text: str, category: str, max_labelled: int | None = None) -> list[tuple[str, str]]:
    """All labelled rows; with ``max_labelled`` at most so many, chosen by a hash of the text."""
    rows = snippets.select(text, category).dropna()
    if max_labelled is not None:
        rows = rows.orderBy(F.xxhash64(text), text).limit(max_labelled)
    return [tuple(r) for r in rows.collect()]


def _kind(model: Model) -> np.dtype:
    """The type in which ids are stored."""
    return np.dtype(np.int16 if model.words.size <= np.iinfo(np.int16).max else np.int32)


def read(df: DataFrame, key: str, text: str, model: Model, keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, text_hash, ids) of every row: a hash that equal texts share (null for null), and the ids of the words, END last.

    Ids depend on the model's words only, so they hold for every model made from ``model`` by a background.
    """
    rows = df.select(key, *keep, text)
    names, kind = [key, *keep], _kind(model)
    out = T.StructType([*[rows.schema[c] for c in names], T.StructField("text_hash", T.BinaryType()), T.StructField("ids", T.BinaryType())])
    sent = df.sparkSession.sparkContext.broadcast(model.prepare())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                texts = b.column(len(names)).to_pylist()
                hashes = [None if t is None else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
                ids = [np.append(scorer.ids(readable(t)), END).astype(kind).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hashes, pa.binary()), pa.array(ids, pa.binary())], names=[*names, "text_hash", "ids"])

    return rows.mapInArrow(run, out)


def _is_plain(n_texts: int, sentence: bool, n: int, score: float) -> bool:
    return (sentence and score < PLAIN) or (n >= max(COMMON_TEXTS, COMMON * n_texts) and score < THRESHOLD + CONTRADICTED)


class _Parts:
    """Counts, by texts that have them, of sentences and of the windows in those that don't look plain."""

    def __init__(self, model: Model) -> None:
        self.model, self.kind = model, _kind(model)
        self.end = np.array([END], dtype=self.kind).tobytes()
        #: Sentences met, with their scores and windows; windows with their scores.
        self.sentences: dict[bytes, tuple[float, tuple[bytes, ...]]] = {}
        self.windows: dict[bytes, float] = {}
        self.n: Counter = Counter()

    def _scores(self, parts: Sequence[bytes]) -> list[float]:
        return self.model.best(*_joined([p + self.end for p in parts], self.kind)).tolist()

    def add(self, texts: Sequence[bytes]) -> None:
        ids, offsets = _joined(texts, self.kind)
        size, raw = self.kind.itemsize, b"".join(texts)
        found = {(t, raw[lo * size : hi * size]) for lo, hi, t in zip(*(x.tolist() for x in _cut(ids, offsets)), strict=True)}
        new = list({s for _, s in found} - self.sentences.keys())
        for s, score in zip(new, self._scores(new), strict=True):
            last = max(1, len(s) // size - WINDOW + 1) if score >= PLAIN else 0
            self.sentences[s] = score, tuple(s[i * size : (i + WINDOW) * size] for i in range(last))
        within = {(t, w) for t, s in found for w in self.sentences[s][1]}
        new = list({w for _, w in within} - self.windows.keys())
        self.windows.update(zip(new, self._scores(new), strict=True))
        self.n.update((s, True) for _, s in found)
        self.n.update((w, False) for _, w in within)

    def full(self) -> bool:
        return len(self.sentences) + len(self.windows) > MOST_REMEMBERED

    def taken(self) -> pa.RecordBatch:
        """What was counted; begins anew."""
        keys = list(self.n)
        scores = [self.sentences[p][0] if sentence else self.windows[p] for p, sentence in keys]
        columns = [pa.array([p for p, _ in keys], pa.binary()), pa.array([x for _, x in keys], pa.bool_()), pa.array(self.n.values(), pa.int64()), pa.array(scores, pa.float64())]
        for x in (self.n, self.sentences, self.windows):
            x.clear()
        return pa.RecordBatch.from_arrays(columns, names=["part", "sentence", "n", "score"])


def _plain_parts(read_texts: DataFrame, model: Model) -> tuple[int, DataFrame]:
    """The number of distinct texts of ``read``'s rows, and (part, sentence, n, score) of all their distinct parts that are ordinary."""
    n_texts = read_texts.select(F.count_distinct("text_hash")).first()[0]
    texts = read_texts.where("text_hash is not null").select("ids", "text_hash").distinct()
    sent = read_texts.sparkSession.sparkContext.broadcast(model.prepare())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                parts.add(batch.column(0).slice(at, ROWS).to_pylist())
                if parts.full():
                    yield parts.taken()
        yield parts.taken()

    kinds = texts.mapInArrow(run, "part binary, sentence boolean, n long, score double").groupBy("part", "sentence").agg(F.sum("n").alias("n"), F.max("score").alias("score"))
    common = (F.col("n") >= max(COMMON_TEXTS, COMMON * n_texts)) & (F.col("score") < THRESHOLD + CONTRADICTED)
    return n_texts, kinds.where((F.col("sentence") & (F.col("score") < PLAIN)) | common)


def background_counts(read_texts: DataFrame, model: Model) -> dict[tuple[int, int, int], int]:
    """The trigrams in the ordinary parts of all of ``read``'s texts, with their counts.

    Parts are sentences of up to ``PIECE`` words, and the windows in those that don't look plain; equal texts count once. A part
    counts as often as texts have it, or what is common would weigh less the more other parts an archive has. Parts
    stay on the executors; the driver gets the distinct trigrams, in which all words that the model doesn't know are one.
    """
    kind = _kind(model)
    end = np.array([END], dtype=kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, offsets = _joined([p + end for p in batch.column(0).to_pylist()], kind)
            b = np.concatenate([[END], c[:-1]])[: len(c)]
            a = np.where(b == END, END, np.concatenate([[END], b[:-1]])[: len(c)])
            order = np.lexsort((c, b, a))
            abc = np.stack((a, b, c))[:, order]
            first = np.flatnonzero(np.append(True, (abc[:, 1:] != abc[:, :-1]).any(axis=0))[: len(c)])
            n = np.add.reduceat(np.repeat(batch.column(1).to_numpy(), np.diff(offsets))[order], first)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first], pa.int32()) for x in abc), pa.array(n, pa.int64())], names=["a", "b", "c", "n"])

    _, parts = _plain_parts(read_texts, model)
    found = parts.select("part", "n").mapInArrow(run, "a int, b int, c int, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(zip(*(found[x].to_pylist() for x in "abc")), found["n"].to_pylist(), strict=True))


def with_counts(model: Model, more: Mapping[tuple[int, int, int], int]) -> Model:
    """``model`` with the trigrams of ``background_counts`` as ordinary ones.

    Abuse is rare, so what is common is ordinary. A whole sentence that the model takes for toxic is in no ordinary part.
    """
    return Model(model.words, model.toxic, model.ordinary, more).prepare()


Part = tuple[tuple[int, ...], bool, int, float]


def background(df: DataFrame, key: str, text: str, model: Model, most_texts: int | None = None, most_parts: int | None = None) -> tuple[int, list[Part]]:
    """The number of distinct texts, and (ids, is a sentence, texts that have it, score) of their ordinary parts, one by one.

    This brings the parts themselves to the driver, for a look at them; ``background_counts`` has what they add up to. ``most_texts``
    and ``most_parts`` are bounds for that, by a hash of the key and of the part; without them it's all of them.
    """
    rows = df
    if most_texts is not None:
        rows = df.select(key, text).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(most_texts)
    n_texts, parts = _plain_parts(read(rows, key, text, model), model)
    parts = parts.orderBy(F.xxhash64("part"), "part", "sentence")
    kind = _kind(model)
    found = (parts if most_parts is None else parts.limit(most_parts)).collect()
    return n_texts, [(tuple(np.frombuffer(r.part, dtype=kind).tolist()), r.sentence, r.n, r.score) for r in found]


def with_background(model: Model, n_texts: int, parts: Iterable[Part]) -> Model:
    """``model`` with ordinary parts of the archive's own texts: sentences that it scores below ``PLAIN``, and what more than
    ``COMMON`` of all texts have unless it's toxic by far, each as often as texts have it. Abuse is rare, so what is common is ordinary."""
    plain = [(list(ids), n) for ids, sentence, n, score in parts if _is_plain(n_texts, sentence, n, score)]
    return Model(model.words, model.toxic, [*model.ordinary, *plain]).prepare()


_SCORERS: dict[str, Scorer] = {}


def _scorer(sent) -> Scorer:
    """The scorer of a broadcast model; a Python worker makes it once, with all it remembers of words, for all its tasks."""
    model = sent.value
    if model.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.name] = Scorer(model)
    return _SCORERS[model.name]


def scored(read_texts: DataFrame, key: str, model: Model, threshold: float = THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, score, flagged) of every row of ``read``; ``flagged`` where the score reaches ``threshold``."""
    names, kind = [key, *keep], _kind(model)
    rows = read_texts.select(*names, "ids")
    out = T.StructType([*[rows.schema[c] for c in names], T.StructField("score", T.DoubleType()), T.StructField("flagged", T.BooleanType())])
    sent = rows.sparkSession.sparkContext.broadcast(model.prepare())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                s = sent.value.best(*_joined(b.column(len(names)).to_pylist(), kind))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array(s >= threshold)], names=[*names, "score", "flagged"])

    return rows.mapInArrow(run, out)


def rates(scores: DataFrame, source: str) -> DataFrame:
    """Per source: texts, flagged texts, and their rate. A null source is a source."""
    return scores.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(F.col("flagged").cast("long")).alias("n_flagged"),
        F.avg(F.col("flagged").cast("double")).alias("rate"),
    )
