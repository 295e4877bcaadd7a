"""Labels the language of each word of a text, and of the text as a whole."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_rows, pick
from .textscan import LOWER, NOT_SPACE, Step, mix, steps, words

#: Hashed places of letter trigrams; the model has this many counts per language, whatever the corpus.
PLACES = 1 << 16
#: Languages that a model may have: their tables are sent to every task, PLACES numbers of 4 bytes for each.
MOST_LANGS = 1_000
#: Nats that a change of language between neighbouring words costs.
SWITCH = 8.0
#: A language is written in the scripts that make up this share of its training letters.
SCRIPT_SHARE = 0.01
#: Word scores (words times languages) that one Viterbi pass holds, and bytes of text that are scored at once.
CELLS, BYTES = 3_000_000, 1 << 19

# Code point ranges of scripts. Letters outside of them are of script 15, "others".
RANGES = (
    (0x0041, 0x024F, 1), (0x0250, 0x02FF, 1), (0x1D00, 0x1DBF, 1), (0x1E00, 0x1EFF, 1), (0x2C60, 0x2C7F, 1), (0xA720, 0xA7FF, 1), (0xAB30, 0xAB6F, 1), (0xFB00, 0xFB06, 1), (0xFF21, 0xFF5A, 1),  # Latin
    (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2),  # Greek
    (0x0400, 0x052F, 3), (0x1C80, 0x1C8F, 3), (0xA640, 0xA69F, 3),  # Cyrillic
    (0x0530, 0x058F, 4), (0xFB13, 0xFB17, 4),  # Armenian
    (0x0590, 0x05FF, 5), (0xFB1D, 0xFB4F, 5),  # Hebrew
    (0x0600, 0x06FF, 6), (0x0750, 0x077F, 6), (0x0870, 0x08FF, 6), (0xFB50, 0xFDFF, 6), (0xFE70, 0xFEFF, 6),  # Arabic
    (0x0700, 0x074F, 7), (0x0780, 0x086F, 7),  # Syriac, Thaana, N'Ko, Samaritan, Mandaic
    (0x0900, 0x0DFF, 8),  # scripts of India and Sri Lanka
    (0x0E00, 0x109F, 9), (0x1780, 0x17FF, 9),  # Thai, Lao, Tibetan, Myanmar, Khmer
    (0x10A0, 0x10FF, 10), (0x1C90, 0x1CBF, 10), (0x2D00, 0x2D2F, 10),  # Georgian
    (0x1200, 0x139F, 11), (0x2D80, 0x2DDF, 11), (0xAB00, 0xAB2F, 11),  # Ethiopic
    (0x3040, 0x30FF, 12), (0x31F0, 0x31FF, 12), (0xFF66, 0xFF9F, 12),  # kana
    (0x2E80, 0x2FDF, 13), (0x3005, 0x3007, 13), (0x3400, 0x9FFF, 13), (0xF900, 0xFAFF, 13), (0x20000, 0x3FFFF, 13),  # Han
    (0x1100, 0x11FF, 14), (0x3130, 0x318F, 14), (0xA960, 0xA97F, 14), (0xAC00, 0xD7FF, 14), (0xFFA0, 0xFFDC, 14),  # Hangul
)
#: Marks join the letters they stand by in trigrams, but are not letters.
MARK = 16
SCRIPTS = 17


@cache
def kinds() -> np.ndarray:
    """The script of each code point that is a letter (general categories L), MARK for marks (M), 0 for all others."""
    general = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    of = np.frombuffer(general.encode(), np.uint8)
    script = np.full(len(of), 15, np.uint8)
    for low, high, k in RANGES:
        script[low : high + 1] = k
    return np.where(of == ord("L"), script, np.where(of == ord("M"), MARK, 0)).astype(np.uint8)


def kinds_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of UTF-8 text the kind of its code point, and whether it is the first byte of a letter."""
    table = kinds()
    kind = table[data]  # right for ASCII
    first = (kind > 0) & (kind < MARK)
    at = np.flatnonzero(data >= 0xC0)
    if not len(at):
        return kind, first
    lead, size = data[at].astype(np.uint32), len(data)
    code = np.where(lead < 0xE0, lead & 0x1F, np.where(lead < 0xF0, lead & 0x0F, lead & 0x07))
    length = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    for i in range(1, 4):
        more = length > i
        code[more] = code[more] << 6 | data[np.minimum(at[more] + i, size - 1)] & 0x3F
    own = table[np.minimum(code, len(table) - 1)]
    kind[data >= 0x80], first[data >= 0x80] = 0, False
    kind[at], first[at] = own, (own > 0) & (own < MARK)
    for i in range(1, 4):
        more = length > i
        kind[np.minimum(at[more] + i, size - 1)] = own[more]
    return kind, first


class Scan(NamedTuple):
    doc: np.ndarray  #: the document of each word
    firsts: np.ndarray
    script: np.ndarray  #: the script of each word, 0 without letters
    letters: np.ndarray  #: letters of each word
    places: np.ndarray  #: hashed trigrams, word after word
    counts: np.ndarray  #: trigrams of each word


def scan(step: Step) -> Scan:
    """Words with their scripts, letters and trigrams. A word's trigrams run over the word and one border on each side."""
    found = words(step, NOT_SPACE)
    n = len(found.starts)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Scan(none, found.firsts, none, none, none, none)
    data = LOWER[step.data]
    lengths = found.ends - found.starts
    segments = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(found.starts - segments, lengths)
    body = data[at]
    kind, first = (x[at] for x in kinds_of(step.data))
    by_word = np.maximum.reduceat(np.where(kind < MARK, kind, 0), segments)
    letters = np.add.reduceat(first.astype(np.int64), segments)
    symbol = np.where(kind > 0, body, 0).astype(np.uint32)
    before, after = np.zeros_like(symbol), np.zeros_like(symbol)
    before[1:], after[:-1] = symbol[:-1], symbol[1:]
    before[segments], after[segments + lengths - 1] = 0, 0
    code = before << np.uint32(16) | symbol << np.uint32(8) | after
    return Scan(found.doc, found.firsts, by_word, letters, (mix(code) & np.uint64(PLACES - 1)).astype(np.int64), lengths)


class Model(NamedTuple):
    langs: list[str]
    logp: np.ndarray  #: PLACES x languages, float32
    allowed: np.ndarray  #: scripts x languages, bool
    best_prior: int

    def word_scores(self, s: Scan) -> np.ndarray:
        """Log-probabilities of each word by language, minus infinity-like values where the script rules a language out,
        and zeros for words without letters or in scripts that no language is written in."""
        segments = np.cumsum(s.counts) - s.counts
        scores = np.add.reduceat(self.logp[s.places], segments, axis=0) if len(s.counts) else np.zeros((0, len(self.langs)), np.float32)
        allowed = self.allowed[s.script]
        scores = np.where(allowed, scores, np.float32(-1e4))
        scores[~allowed.any(axis=1) | (s.letters == 0)] = 0
        return scores


def viterbi(scores: np.ndarray, firsts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word: per document the path with the largest sum of scores minus ``switch`` per change.

    All documents advance together, longest first, so a step is one vector operation over those that still have words.
    Ties keep the label; between languages the first wins.
    """
    lengths = np.diff(firsts)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = firsts[:-1][order], lengths[order]
    n_docs = int(np.searchsorted(-lengths, 0, "left"))  # those with words
    back = np.zeros(scores.shape, np.uint8 if scores.shape[1] < 256 else np.uint16)
    own = np.arange(scores.shape[1], dtype=back.dtype)
    if not n_docs:
        return np.zeros(len(scores), np.int64)
    value = scores[begin[:n_docs]].astype(np.float64)
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # documents with more than t words
    final = np.zeros(n_docs, np.int64)
    for t in range(1, longest):
        k = active[t]
        if k < len(value):
            final[k : len(value)] = value[k:].argmax(axis=1)
            value = value[:k]
        best = value.argmax(axis=1)
        jump = value[np.arange(k), best] - switch
        stay = value >= jump[:, None]
        at = begin[:k] + t
        back[at] = np.where(stay, own, best[:, None])
        value = np.where(stay, value, jump[:, None]) + scores[at]
    final[: len(value)] = value.argmax(axis=1)
    labels = np.zeros(len(scores), np.int64)
    now = np.zeros(n_docs, np.int64)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        ended = lengths[:k] == t + 1
        now[:k][ended] = final[:k][ended]
        at = begin[:k] + t
        labels[at] = now[:k]
        if t:
            now[:k] = back[at, now[:k]]
    return labels


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """Trigram and script counts by language over every labelled row (lang, text), summed by tasks and then over tasks.
    Nulls in either are left out; without any labelled text there is no model. Over MOST_LANGS languages are an error."""
    labelled = pick(labelled, lang_col, text_col).toDF("lang", "text").filter("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        width = PLACES + SCRIPTS + 1
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            sums = [counts.setdefault(x, np.zeros(width, np.int64)) for x in names]
            for step in steps(batch.column(1), BYTES):
                s = scan(step)
                lang = index[step.first : step.first + step.n]
                of_word = lang[s.doc]
                for k in np.unique(lang).tolist():
                    mine = of_word == k
                    real = np.repeat(mine & (s.letters > 0), s.counts)
                    sums[k][:PLACES] += np.bincount(s.places[real], minlength=PLACES)
                    sums[k][PLACES : PLACES + SCRIPTS] += np.bincount(s.script[mine], s.letters[mine], SCRIPTS).astype(np.int64)
                    sums[k][-1] += int((lang == k).sum())
        for name, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "place", "n"])

    summed = labelled.mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    summed = checkpoint(summed)
    if (n := summed.select("lang").distinct().count()) > MOST_LANGS:
        raise ValueError(f"{n} languages, over {MOST_LANGS}: lang_col does not hold language codes, or the models do not fit a task")
    rows = summed.toPandas()
    if rows.empty:
        return None
    langs = sorted(rows["lang"].unique())
    table = np.zeros((len(langs), PLACES + SCRIPTS + 1))
    table[np.searchsorted(langs, rows["lang"].to_numpy().astype(str)), rows["place"]] = rows["n"]
    grams = table[:, :PLACES] + 0.5
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    script = table[:, PLACES : PLACES + SCRIPTS]
    allowed = (script / np.maximum(1, script.sum(axis=1, keepdims=True)) >= SCRIPT_SHARE).T
    allowed[0] = False
    return Model(langs, np.ascontiguousarray(logp), allowed, int(table[:, -1].argmax()))


def label_batch(model: Model, column: pa.Array) -> list[tuple[str, float, list]]:
    """(language, score, spans) of each text of a batch."""
    out: list = []
    n_lang = len(model.langs)
    pending: list[tuple[np.ndarray, ...]] = []  # per step: word offsets of texts, letters, whether a language may be told, scores

    def flush() -> None:
        if not pending:
            return
        shift = np.cumsum([0, *(len(p[1]) for p in pending)])
        firsts = np.concatenate([[0], *(p[0][1:] + o for p, o in zip(pending, shift, strict=False))])
        letters, known, scores = (np.concatenate([p[i] for p in pending]) for i in (1, 2, 3))
        pending.clear()
        labels = viterbi(scores, firsts)
        n_docs = len(firsts) - 1
        doc = np.repeat(np.arange(n_docs), np.diff(firsts))
        votes = np.bincount(doc * n_lang + labels, letters * known, n_docs * n_lang).reshape(n_docs, n_lang)
        total = np.bincount(doc, letters, n_docs)
        new = np.ones(len(labels), bool)
        new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
        run = np.flatnonzero(new)
        by = np.searchsorted(run, firsts)
        stop = np.append(run[1:], len(labels))
        for d in range(n_docs):
            if total[d] == 0:
                out.append(("und", 0.0, []))
                continue
            best = int(votes[d].argmax()) if votes[d].any() else model.best_prior
            spans = [(int(run[i] - firsts[d]), int(stop[i] - firsts[d]), model.langs[labels[run[i]]]) for i in range(by[d], by[d + 1])]
            out.append((model.langs[best], float(votes[d, best] / total[d]), spans))

    cells = 0
    for step in steps(column, BYTES):
        s = scan(step)
        known = model.allowed[s.script].any(axis=1) & (s.letters > 0)
        pending.append((s.firsts, s.letters.astype(np.int32), known, model.word_scores(s)))
        cells += len(s.doc) * n_lang
        if cells >= CELLS:
            flush()
            cells = 0
    flush()
    return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """Per document (id, lang_pred, score[, spans]).

    The script of a word narrows the languages it can be in, letter trigrams score the rest, and the best path over the
    words, with a penalty per change, labels spans. lang_pred is the language of most letters and score its share of all
    letters. A letter is a code point of the general categories L. ``und`` with score 0 stands for null texts, texts without
    a letter, and any text when there is no model;
    letters in scripts never seen in training count against the score, and a text of nothing else gets the commonest
    language with score 0. spans are (first word, end word, language).
    """
    docs = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = label_batch(model, batch.column(1)) if model else [("und", 0.0, [])] * batch.num_rows
            langs, scores, parts = zip(*found, strict=True) if found else ((), (), ())
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                columns.append(pa.array([[dict(zip(("first", "end", "lang"), p, strict=True)) for p in x] for x in parts], kind))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "score", "spans"][: len(columns)])

    schema = "id long, lang_pred string, score double" + ", spans array<struct<first:int,end:int,lang:string>>" * spans
    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """Drops documents whose language cannot be told: no letters, or a score under ``least``. All columns stay. Without a
    model nothing can be told of any document, and all are kept."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label_batch(sent.value, batch.column(at))
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score, _ in found], pa.bool_()))

    return map_rows(docs, run)
