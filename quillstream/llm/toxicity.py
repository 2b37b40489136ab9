"""Abusive, hateful or sexual content: class-conditional Kneser-Ney models over sentences."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm import kneser_ney
from quillstream.runtime import cut

# fixed values: letters that digits and signs stand for
LEET = str.maketrans("013457@$!", "oieastasi")
# fixed values: letters of other scripts that look like Latin ones
LOOKS = str.maketrans("аеорсухіјѕԁһꞵοαεικντρυω", "aeopcyxijsdhboaeikvtpuw")
START, END, UNKNOWN, NUMBER, MASKED, MIXED, QUOTE, SHOUT, ASK = range(9)
SPECIAL = ["<s>", "</s>", "<unknown>", "<number>", "<masked>", "<mixed>", "<quote>", "!", "?"]
FOLDS = 5
WINDOW = 12
UNIT = 20  # a sentence of more than two units is no sentence; its units are judged apart

# marks in the stream of tokens, and their numbers
TEXT, OPEN, CLOSE = "\x00", "\x01", "\x02"
END_OF_TEXT, OPENS, CLOSES, STOP = -1, -2, -3, -4
_MARKS = {TEXT: END_OF_TEXT, OPEN: OPENS, CLOSE: CLOSES}

# a body without its own opening sign, so that many signs that are never closed cost no more than one
_QUOTED = re.compile(r'"[^"\n\x00]+"|“[^“”\n\x00]+”|„[^„“”\n\x00]+[“”]|«[^«»\n\x00]+»|‘[^‘’\n\x00]+’')
_SINGLE = re.compile(r"'(?<!\w')[^'\n\x00]{3,}'(?!\w)")
_TOKEN = re.compile(r"[\x00\x01\x02\n]|[.!?…]+\s+|[^\W_](?:[\w'’*@$!]*[^\W_])?|[!?]")
_SPELT = re.compile(r"(?:[^\W\d_][_*]){3,}[^\W\d_]")
_WRAPPED, _HYPHEN = re.compile(r"\n(?=[a-zà-ÿ])"), re.compile(r"-\n(?=[a-zà-ÿ])")
_UNSEEN = re.compile("[­​-‏‪-‮⁠-⁯﻿]")
_LATIN = re.compile("[a-z]")


def _marked(quotation: re.Match) -> str:
    inside = quotation[0][1:-1]
    return quotation[0] if OPEN in inside or CLOSE in inside else f" {OPEN}{inside}{CLOSE} "


def tokens(texts: list[str | None]) -> list[str]:
    """Words of all texts in order, without case or accents of form, letters set apart and words cut at a line's end joined again, and between them marks: ends of sentences and texts, and where a quotation within a paragraph opens and closes."""
    plain = []
    for text in texts:
        text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
        if not text.isascii():
            text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
        plain.append(text.translate({0: " ", 1: " ", 2: " "}) if "\x00" in text or "\x01" in text or "\x02" in text else text)
    whole = TEXT.join([*plain, ""])
    if "-\n" in whole:
        whole = _HYPHEN.sub("", whole)
    whole = _WRAPPED.sub(" ", whole)
    for pattern in (_QUOTED, _SINGLE):
        whole = pattern.sub(_marked, whole)
    whole = whole.lower()
    found = _TOKEN.findall(whole)
    letters = np.fromiter(map(len, found), np.int64, len(found)) == 1
    if letters.any():
        letters[letters] = [found[k].isalpha() for k in np.flatnonzero(letters)]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], letters, [False]]).astype(np.int8)))
        runs = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= 4]
        for a, b in reversed(runs):  # letters set apart
            found[a:b] = ["".join(found[a:b])]
    return found


def signature(word: str) -> str:
    return "".join(sorted(word))


class Vocabulary(dict):
    """Numbers of known words and of marks; a word with its letters in another order, or with digits for letters, gets the number of the word meant. Looked-up words are kept."""

    def __init__(self, words: list[str]):
        super().__init__()
        self.number = {w: k for k, w in enumerate([*SPECIAL, *sorted(set(words) - set(SPECIAL))])}
        self.mixed: dict[str, int] = {}
        for word, k in self.number.items():
            if len(word) >= 4 and word.isalpha():
                s = signature(word)
                self.mixed[s] = -1 if s in self.mixed else k
        self.mixed = {s: k for s, k in self.mixed.items() if k >= 0}

    def __reduce__(self):
        return Vocabulary, (list(self.number),)

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        first = token[0]
        if token in _MARKS:
            k = _MARKS[token]
        elif first == "\n" or (first in ".!?…" and token not in "!?"):
            k = STOP
        else:
            k = self.lookup(token)
        self[token] = k
        return k

    def lookup(self, word: str) -> int:
        k = self.number.get(word)
        if k is not None:
            return k
        if word.isalpha():
            if not word.isascii() and _LATIN.search(word) and (plain := word.translate(LOOKS)) != word:
                return self.lookup(plain)
            return self.mixed.get(signature(word), UNKNOWN) if len(word) >= 4 else UNKNOWN
        if _SPELT.fullmatch(word):
            return self.lookup(re.sub("[_*]", "", word))
        if "*" in word:
            return MASKED
        plain = word.translate(LEET)
        if plain.isalpha():
            k = self.number.get(plain) or self.mixed.get(signature(plain))
            if k:
                return k
        return NUMBER if word[0].isdigit() else MIXED

    def stream(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))


@dataclass
class Units:
    """The trigrams of a stream of numbers. ``sentence`` and ``unit`` number where each ends, ``text`` is the text of each unit."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    sentence: np.ndarray
    unit: np.ndarray
    text: np.ndarray

    @staticmethod
    def of(stream: np.ndarray, quoted: bool = False) -> Units:
        """Of the texts' own words, a mark in the place of each quotation, or of the quoted words.

        Each trigram of a sentence is there once, the two before its first word being START. A sentence of more than ``2 * UNIT``
        words consists of several units, all others are one. Sentences of nothing but one sign or quotation are left out.
        """
        stream = stream.astype(np.int64)
        text = np.cumsum(stream == END_OF_TEXT) - (stream == END_OF_TEXT)
        inside = np.cumsum(stream == OPENS) > np.cumsum(stream == CLOSES)
        if quoted:
            keep = inside | (stream == CLOSES) | (stream == END_OF_TEXT)
            stops = [END_OF_TEXT, OPENS, CLOSES, STOP]
        else:
            keep = ~inside & (stream != CLOSES) | (stream == OPENS)
            stream = np.where(stream == OPENS, QUOTE, stream)
            stops = [END_OF_TEXT, STOP]
        stream, text = stream[keep], text[keep]
        stop = np.isin(stream, stops)
        number = np.cumsum(stop) - stop
        words, text, number = stream[~stop], text[~stop], number[~stop]
        number = np.unique(number, return_inverse=True)[1]
        size = np.bincount(number) if len(number) else np.zeros(0, np.int64)
        bare = np.isin(words, [QUOTE, SHOUT, ASK]) & (size[number] == 1)
        words, text, number = words[~bare], text[~bare], number[~bare]
        number = np.unique(number, return_inverse=True)[1]
        size = np.bincount(number) if len(number) else np.zeros(0, np.int64)
        begin = np.cumsum(size) - size
        # END after each sentence
        total = len(words) + len(size)
        sentence = np.repeat(np.arange(len(size)), size + 1)
        place = np.arange(total) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        c = np.full(total, END, np.int64)
        c[place < size[sentence]] = words
        b, a = np.full(total, START, np.int64), np.full(total, START, np.int64)
        b[1:][place[1:] > 0] = c[:-1][place[1:] > 0]
        a[2:][place[2:] > 1] = c[:-2][place[2:] > 1]
        parts = np.where(size > 2 * UNIT, -(-size // UNIT), 1)
        first = np.cumsum(parts) - parts
        unit = first[sentence] + np.minimum(place // UNIT, parts[sentence] - 1) * (parts[sentence] > 1)
        return Units(a, b, c, sentence, unit, np.repeat(text[begin] if len(size) else text[:0], parts))

    def __len__(self) -> int:
        return len(self.text)


@dataclass
class Classifier:
    """The two models, and the score from which a document is flagged."""

    vocabulary: Vocabulary
    models: kneser_ney.Models
    threshold: float = 0.0

    def scores(self, units: Units) -> np.ndarray:
        """For each unit the difference of the log-likelihoods per word, with two words more in the length so that the shortest sentences don't swing widest.

        In a sentence of more words than a window has, the worst window counts if it is worse: two sentences may stand there without a stop between them.
        """
        if not len(units):
            return np.zeros(0)
        toxic, ordinary = self.models.log_prob(units.a, units.b, units.c)
        gain = toxic - ordinary
        new = (units.c == UNKNOWN) | (units.c == MIXED)  # a word no class knows is no sign of the smaller class
        gain[new] = np.minimum(gain[new], 0)
        size = np.bincount(units.unit)
        score = np.bincount(units.unit, weights=gain) / (size + 2)
        if len(gain) > WINDOW:
            total = np.concatenate([[0.0], np.cumsum(gain)])
            long = np.bincount(units.sentence) > WINDOW + 4
            head = units.sentence[: 1 - WINDOW]
            at = np.flatnonzero((head == units.sentence[WINDOW - 1 :]) & long[head])
            np.maximum.at(score, units.unit[at + WINDOW - 1], (total[at + WINDOW] - total[at]) / (WINDOW + 2))
        return score


@dataclass
class Contrast:
    """How much more frequent each trigram is in toxic than in ordinary documents, to sort sentences before there are models.

    A few wrongly labelled documents are enough to teach a model of ordinary text how an insult goes on once it has begun; against
    the many rightly labelled ones they hardly change how frequent it is.
    """

    vocabulary: Vocabulary
    keys: np.ndarray
    gain: np.ndarray

    def scores(self, units: Units) -> np.ndarray:
        """Mean over the words of the logarithm of the ratio, 0 for trigrams seen nowhere."""
        if not len(units):
            return np.zeros(0)
        size = len(self.vocabulary.number)
        at = kneser_ney._at(self.keys, (units.a * size + units.b) * size + units.c)
        return np.bincount(units.unit, weights=np.append(self.gain, 0.0)[at]) / np.bincount(units.unit)


def label_class(label: Column) -> Column:
    """'toxic' for any spelling of the three kinds, 'ordinary' for none, null for all else."""
    plain = F.lower(F.trim(label))
    return F.when(plain.rlike("^(abus|hate|sex|toxic)"), "toxic").when(plain.rlike("^(none|no|ok|clean|ordinary)$"), "ordinary")


def _labelled(documents: DataFrame, labels: DataFrame, most: int, most_characters: int) -> DataFrame:
    """One class per labelled document by majority (ties give none), at most about ``most`` documents and ``most_characters`` characters of each class chosen by the hash of their id; ``weight``: how many each stands for."""
    votes = labels.select(F.col("doc_id"), label_class(F.col("label")).alias("kind")).where("doc_id is not null and kind is not null")
    sure = votes.groupBy("doc_id").agg(F.sum(F.when(F.col("kind") == "toxic", 1).otherwise(-1)).alias("balance")).where("balance != 0")
    classed = cut(sure.select("doc_id", (F.col("balance") > 0).alias("toxic")))
    rate = {True: 1.0, False: 1.0}
    for r in classed.groupBy("toxic").agg(F.count("*").alias("n")).collect():
        rate[r["toxic"]] = min(1.0, most / r["n"])
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = lambda: F.when(F.col("toxic"), rate[True]).otherwise(rate[False])
    chosen = classed.where(spot < share() * 1_000_000)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # about 2 x most rows
    for r in rows.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect():
        rate[r["toxic"]] *= min(1.0, most_characters / max(1, r["n"]))
    return rows.where(spot < share() * 1_000_000).withColumn("weight", 1 / share())


def _words(rows: DataFrame) -> list[str]:
    """The words that occur in a toxic document or more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            texts = np.array(batch.column("text").to_pylist(), object)
            for kind in (True, False):
                n = Counter(tokens(texts[toxic == kind].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([kind] * len(n), pa.bool_())], names=["word", "n", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(run, "word string, n long, toxic boolean").groupBy("word").agg(F.sum("n").alias("n"), F.max("toxic").alias("toxic"))
    return [w for w in (r["word"] for r in seen.where("n > 1 or toxic").select("word").toLocalIterator()) if w.isalpha()]


STREAMS = "doc_id long, toxic boolean, weight double, fold int, stream binary, kinds binary"
_OUT = 2


def _streams(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A row per labelled document: its words as numbers, and the class that each of its units is taken for (1 toxic, 0 ordinary, 2 neither), at first that of the document."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stream = held.value.stream(tokens(batch.column("text").to_pylist()))
            ends = np.flatnonzero(stream == END_OF_TEXT) + 1
            parts = [stream[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            kinds = [np.full(len(Units.of(p)), t, np.int8).tobytes() for p, t in zip(parts, batch.column("toxic").to_pylist())]
            cols = [*(batch.column(c) for c in ("doc_id", "toxic", "weight", "fold")), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(kinds, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in STREAMS.split(", ")])

    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    return rows.select("doc_id", "toxic", "weight", fold.alias("fold"), "text").mapInArrow(run, STREAMS)


def _joined(values: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), kind)


def _counts(marked: DataFrame, size: int) -> dict[tuple[bool, int], tuple[np.ndarray, np.ndarray]]:
    """Trigram counts by class and fold, counted on the cluster; as many at most as the words of the bounded sample."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = Units.of(_joined(batch.column("stream"), np.int32))
            kinds, folds = _joined(batch.column("kinds"), np.int8)[units.unit], batch.column("fold").to_numpy()[units.text[units.unit]]
            key = (units.a * size + units.b) * size + units.c
            for k in (0, 1):
                for fold in np.unique(folds):
                    some, n = np.unique(key[(kinds == k) & (folds == fold)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([bool(k)] * len(some), pa.bool_()), pa.array([fold] * len(some), pa.int32()), pa.array(some), pa.array(n)], names=["kind", "fold", "gram", "n"])

    found = marked.select("stream", "kinds", "fold").mapInArrow(grams, "kind boolean, fold int, gram long, n long").groupBy("kind", "fold", "gram").agg(F.sum("n").alias("n")).toArrow()
    kind, fold, gram, n = (found.column(c).to_numpy() for c in ("kind", "fold", "gram", "n"))
    return {(k, f): (gram[s], n[s]) for k in (True, False) for f in range(FOLDS) if (s := (kind == k) & (fold == f)) is not None}


def _class_counts(counts: dict, without: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Trigrams and their counts of the toxic and of the ordinary class, one fold left out."""
    out = []
    for kind in (True, False):
        some = [v for (k, f), v in counts.items() if k == kind and f != without]
        keys, at = np.unique(np.concatenate([s[0] for s in some]).astype(np.int64), return_inverse=True)
        out.append((keys, np.bincount(at, weights=np.concatenate([s[1] for s in some]), minlength=len(keys))))
    return out


def _models(counts: dict, vocabulary: Vocabulary, without: int | None) -> Classifier:
    keys, n = zip(*_class_counts(counts, without))
    return Classifier(vocabulary, kneser_ney.fit(len(vocabulary.number), list(keys), list(n)))


def _contrast(counts: dict, vocabulary: Vocabulary, without: int | None, strength: float = 2.0) -> Contrast:
    """Ratios shrunk towards 1 as if each trigram had been seen ``strength`` times more, in proportion to the classes."""
    parts = _class_counts(counts, without)
    keys = np.unique(np.concatenate([p[0] for p in parts]))
    n = [np.zeros(len(keys)) for _ in parts]
    for k, (some, many) in enumerate(parts):
        n[k][np.searchsorted(keys, some)] = many
    share = np.clip(n[0].sum() / max(n[0].sum() + n[1].sum(), 1), 1e-6, 1 - 1e-6)
    gain = np.log((n[0] + strength * share) / (n[1] + strength * (1 - share)) * (1 - share) / share)
    return Contrast(vocabulary, keys, gain)


def _worst(units: Units, score: np.ndarray, n: int) -> np.ndarray:
    """The highest score in each of ``n`` texts, not a number where a text has no unit."""
    out = np.full(n, np.nan)
    if len(units):
        first = np.flatnonzero(np.diff(units.text, prepend=-1))
        out[units.text[first]] = np.maximum.reduceat(score, first)
    return out


def _judged(marked: DataFrame, judges: list[Classifier] | list[Contrast], first: bool) -> tuple[DataFrame, Broadcast]:
    """The rows with their units classed anew by the judge that hasn't seen their fold, and ``worst``, the highest score in the document; and the broadcast judges, to be dropped once the rows are there."""
    held = marked.sparkSession.sparkContext.broadcast(judges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for fold in sorted(set(whole.column("fold").to_pylist())):
                batch = whole.filter(pa.array(whole.column("fold").to_numpy() == fold))
                units, n = Units.of(_joined(batch.column("stream"), np.int32)), batch.num_rows
                score, toxic = held.value[fold].scores(units), batch.column("toxic").to_numpy(zero_copy_only=False)
                worst = _worst(units, score, n)
                least = np.fmax(1.0, worst / 2) if first else np.full(n, 1.5)
                bad = score > least[units.text]
                kinds = np.where(toxic[units.text], np.where(bad, 1, _OUT), np.where(score < 2, 0, _OUT)).astype(np.int8)
                ends = np.searchsorted(units.text, np.arange(n + 1))
                cols = [*(batch.column(c) for c in ("doc_id", "toxic", "weight", "fold", "stream")), pa.array([kinds[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()), pa.array(worst, mask=np.isnan(worst))]
                yield pa.RecordBatch.from_arrays(cols, names=[*(c.split()[0] for c in STREAMS.split(", ")), "worst"])

    return marked.select("doc_id", "toxic", "weight", "fold", "stream").mapInArrow(run, f"{STREAMS}, worst double"), held


def best_threshold(score: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the scores that part the classes with an F1 of nearly the best; between two classes far apart wrong labels alone would decide on the exact best."""
    order = np.argsort(-score)
    s, t, w = score[order], toxic[order], weight[order]
    hit, all_ = np.cumsum(w * t), np.cumsum(w)
    f1 = 2 * hit / (all_ + (w * t).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    good = np.flatnonzero(f1 >= 0.985 * f1.max())
    return float((s[good[0]] + s[min(good[-1] + 1, len(s) - 1)]) / 2)


def train(documents: DataFrame, labels: DataFrame, most: int = 4000, rounds: int = 2, least: float = 0.8, most_characters: int = 40_000_000) -> Classifier | None:
    """Fit on at most about ``most`` labelled documents and ``most_characters`` of their characters of each class; None if a class is missing.

    A toxic document holds mostly ordinary sentences, and some labels are wrong. So sentences are classed anew, first by how frequent their trigrams are in the two kinds of documents, then by the models, always
    by what has not seen them: of toxic documents only sentences that score as toxic count as such (at first if they do so at least half as much as the worst one), of ordinary ones those that do not clearly score as toxic, and the rest is left out. The
    threshold is that of the best F1 over the labelled documents, again scored by models that haven't seen them, and at least ``least`` (natural logarithm per word): few labels, richer in toxic documents than
    the corpus, know little of what else looks like it.
    """
    rows = _labelled(documents, labels, most, most_characters)
    vocabulary = Vocabulary(_words(rows))
    marked = cut(_streams(rows, vocabulary))
    if {r["toxic"] for r in marked.select("toxic").distinct().collect()} != {True, False}:
        return None
    size = len(vocabulary.number)
    for step in range(rounds + 1):
        counts = _counts(marked, size)
        judged, held = _judged(marked, [(_models if step else _contrast)(counts, vocabulary, f) for f in range(FOLDS)], not step)
        marked = cut(judged)
        held.destroy()
    counts = _counts(marked, size)
    last, held = _judged(marked, [_models(counts, vocabulary, f) for f in range(FOLDS)], False)
    per = last.where("worst is not null").select("worst", "toxic", "weight").toArrow()
    held.destroy()
    model = _models(counts, vocabulary, None)
    best = best_threshold(*(per.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("worst", "toxic", "weight"))) if per.num_rows else least
    model.threshold = max(best, least)
    return model


def score_documents(documents: DataFrame, model: Classifier | None) -> DataFrame:
    """``doc_id, source, score, quoted_score, flagged`` for every document: the scores of its worst sentence of its own words and of its worst quoted one.

    The whole text counts, whatever its length. What stands between quotation marks within a paragraph, however long, isn't the document's own
    and doesn't flag it; it has its score in ``quoted_score`` for review. A score is null where there are no such words. Null and empty texts
    are not flagged. The model is as small as its training sample and is broadcast. With no model all scores are null.
    """
    if model is None:
        none = F.lit(None).cast("double")
        return documents.select("doc_id", "source", none.alias("score"), none.alias("quoted_score"), F.lit(False).alias("flagged"))
    held = documents.sparkSession.sparkContext.broadcast(model)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select("doc_id", "source").schema)

    def worst(units: Units, n: int) -> np.ndarray:
        return _worst(units, held.value.scores(units), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            own, quoted = [np.zeros(0)], [np.zeros(0)]
            texts = batch.column("text").to_pylist()
            ends, at = np.cumsum([len(t or "") for t in texts]), 0
            while at < len(texts):  # about two million characters at a time, one text at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, "right")))
                stream = model.vocabulary.stream(tokens(texts[at:to]))
                own.append(worst(Units.of(stream), to - at))
                quoted.append(worst(Units.of(stream, True), to - at) if (stream == OPENS).any() else np.full(to - at, np.nan))
                at = to
            a, b = np.concatenate(own), np.concatenate(quoted)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(a, mask=np.isnan(a)), pa.array(b, mask=np.isnan(b)), pa.array(a >= model.threshold)],
                names=["doc_id", "source", "score", "quoted_score", "flagged"],
            )

    return documents.select("doc_id", "source", "text").mapInArrow(run, f"{types}, score double, quoted_score double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """``source, documents, flagged, rate`` per source, null being one of them."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("flagged").cast("long")).alias("flagged")).withColumn("rate", F.col("flagged") / F.col("documents"))
