"""Language identification of mixed-language text.

Words are runs of letters. The script of a word narrows its candidate languages;
every candidate gets a log-likelihood from the word's letter trigrams and the word
itself; Viterbi over the words of a text, with a penalty for each switch, labels
spans. The language that labels most letters is the text's.

The model is fitted on a bounded sample of labelled rows (`max_train_docs`), chosen
by a hash of the row's key; tables of counts have a fixed number of buckets.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, mix64, share, slices, utf8

#: First code point of the ranges of Unicode scripts; "" ends a script.
SCRIPT_RANGES = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, ""), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""), (0x2DE0, "Cyrillic"),
    (0x2E00, "Han"), (0x3040, "Hiragana"), (0x30A0, "Katakana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0xA000, ""), (0xA640, "Cyrillic"), (0xA6A0, ""), (0xA720, "Latin"), (0xA800, ""), (0xAC00, "Hangul"),
    (0xD800, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE30, ""),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF65, "Katakana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_STARTS = np.array([0] + [a for a, _ in SCRIPT_RANGES])
_SCRIPT_OF = np.array([SCRIPTS.index("")] + [SCRIPTS.index(name) for _, name in SCRIPT_RANGES])

TRIGRAMS, WORDS = 1 << 16, 1 << 15
FEATURES = TRIGRAMS + WORDS
#: Code points below this have a table; the few above are looked up one by one.
_LAST = 0x30000
LETTER, MARK = 1, 2


def kind_of(c: str) -> int:
    return LETTER if c.isalpha() else MARK if unicodedata.category(c)[0] == "M" else 0


def letter_tables():
    """Which code points are letters and which are marks, and their lower case of equal
    length."""
    chars = list(map(chr, range(_LAST)))
    kind = np.array(list(map(kind_of, chars)), dtype=np.uint8)
    low = [c.lower() for c in chars]
    lower = np.array([ord(l) if len(l) == 1 else i for i, l in enumerate(low)], dtype=np.uint32)
    return kind, lower


def kinds(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    kind = table[np.minimum(points, _LAST - 1)]
    high = np.flatnonzero(points >= _LAST)
    if len(high):
        distinct, at = np.unique(points[high], return_inverse=True)
        kind[high] = np.array([kind_of(chr(p)) for p in distinct], dtype=np.uint8)[at]
    return kind


@dataclass
class Words:
    """Words of a batch: document, first and last character (in its document),
    script, and for each of its letters a trigram bucket."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    word: np.ndarray
    trigram: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, tables) -> Words:
    """Words of the texts data[offsets[i]:offsets[i+1]] (UTF-8): runs of letters and
    marks that hold a letter."""
    table, lower = tables
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = (data & 0xC0) != 0x80
    begin = np.concatenate([[0], np.cumsum(lead)])[offsets] if len(data) else np.zeros(len(offsets), dtype=np.int64)
    kind = kinds(points, table)
    is_letter = kind > 0
    cut = np.zeros(len(points) + 1, dtype=bool)
    cut[begin] = True

    def runs():
        before = np.concatenate([[False], is_letter[:-1]]) if len(points) else is_letter
        after = np.concatenate([is_letter[1:], [False]]) if len(points) else is_letter
        return np.flatnonzero(is_letter & (~before | cut[:-1])), np.flatnonzero(is_letter & (~after | cut[1:])) + 1

    starts, ends = runs()
    if (kind == MARK).any():
        letters = np.concatenate([[0], np.cumsum(kind == LETTER)])
        bare = letters[ends] == letters[starts]
        if bare.any():
            for a, b in zip(starts[bare], ends[bare], strict=True):
                is_letter[a:b] = False
            starts, ends = runs()
    low = np.where(is_letter, np.where(points < _LAST, lower[np.minimum(points, _LAST - 1)], points), 0).astype(np.uint64)
    left, right = np.zeros_like(low), np.zeros_like(low)
    left[1:], right[:-1] = low[:-1], low[1:]
    left[starts], right[ends - 1] = 0, 0
    grams = mix64((left * np.uint64(0x110000) + low) * np.uint64(0x110000) + right)
    grams = grams[is_letter]
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(starts) else np.empty(0, np.int64)
    whole = mix64(np.add.reduceat(grams, first) + lengths.astype(np.uint64)) if len(starts) else np.empty(0, np.uint64)
    doc = np.searchsorted(begin, starts, side="right") - 1
    script = _SCRIPT_OF[np.searchsorted(_STARTS, points[starts], side="right") - 1]
    return Words(doc, starts - begin[doc], ends - begin[doc], script, TRIGRAMS + (whole % np.uint64(WORDS)).astype(np.int64), (grams % np.uint64(TRIGRAMS)).astype(np.int64), first)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # FEATURES x languages
    allowed: np.ndarray  # scripts x languages
    switch: float


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", max_train_docs: int = 20_000, switch: float = 9.0) -> Model:
    """Learn from the rows of docs whose text and language are not null: all of them
    if they are at most about max_train_docs, else a share chosen by a hash of the key."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = labelled.count()
    if n > max_train_docs:
        share = F.pmod(F.xxhash64(F.lit("langid"), F.col(key_col).cast("string")), F.lit(1 << 20))
        labelled = labelled.where(share < int(max_train_docs / n * (1 << 20)))

    def count(batches):
        tables = letter_tables()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                w = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables)
                of_letter = np.repeat(w.doc, w.end - w.start)
                for name in set(names[i:j]):
                    mine = names[i:j] == name
                    total = sums.setdefault(name, np.zeros(FEATURES + len(SCRIPTS), dtype=np.int64))
                    picked = mine[w.doc]
                    total[:TRIGRAMS] += np.bincount(w.trigram[mine[of_letter]], minlength=TRIGRAMS)
                    total[:FEATURES] += np.bincount(w.word[picked], minlength=FEATURES)
                    total[FEATURES:] += np.bincount(w.script[picked], weights=(w.end - w.start)[picked], minlength=len(SCRIPTS)).astype(np.int64)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "feature", "n"])

    rows = (
        labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .mapInArrow(count, "lang string, feature int, n long")
        .groupBy("lang", "feature")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names, features, n = (rows.column(c).to_numpy() for c in ("lang", "feature", "n"))
    languages = sorted(set(names))
    counts = np.zeros((FEATURES + len(SCRIPTS), len(languages)))
    for k, name in enumerate(languages):
        counts[features[names == name], k] = n[names == name]
    logp = np.empty((FEATURES, len(languages)), dtype=np.float32)
    for a, b in ((0, TRIGRAMS), (TRIGRAMS, FEATURES)):
        logp[a:b] = np.log((counts[a:b] + 0.1) / (counts[a:b].sum(axis=0) + 0.1 * (b - a)))
    letters = counts[FEATURES:]
    allowed = letters >= 0.001 * np.maximum(letters.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True  # a script that no language has narrows nothing
    return Model(languages, logp, allowed, switch)


def word_scores(w: Words, model: Model) -> np.ndarray:
    """Log-likelihood of each word in each language; languages of other scripts fall out."""
    if not len(w.doc):
        return np.empty((0, len(model.languages)), dtype=np.float32)
    scores = np.add.reduceat(model.logp[w.trigram], w.first, axis=0) + model.logp[w.word]
    return np.where(model.allowed[w.script], scores - scores.max(axis=1, keepdims=True), np.float32(-1e4))


def viterbi(scores: np.ndarray, first: np.ndarray, length: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word of many texts at once: text i has the words
    first[i] .. first[i]+length[i]-1. Step t handles the t-th words of all texts that
    have one. Ties keep the label, then prefer the first language."""
    kind = np.min_scalar_type(-max(1, scores.shape[1]))
    labels = np.zeros(len(scores), dtype=kind)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    if not len(order):
        return labels
    first, length = first[order], length[order]
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
    source = np.zeros(scores.shape, dtype=kind)
    own = np.arange(scores.shape[1], dtype=kind)
    best = scores[first].astype(np.float64)
    for t in range(1, steps):
        k = active[t]
        rows, best_now = first[:k] + t, best[:k]
        top = best_now.argmax(axis=1)
        most = best_now[np.arange(k), top][:, None] - switch
        stay = best_now >= most
        source[rows] = np.where(stay, own, top[:, None].astype(kind))
        best_now = np.maximum(best_now, most) + scores[rows]
        best[:k] = best_now - best_now.max(axis=1, keepdims=True)
    state = best.argmax(axis=1).astype(kind)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        rows = first[:k] + t
        labels[rows] = state[:k]
        state[:k] = source[rows, state[:k]]
    return labels


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep=None, only: list[str] | None = None, min_score: float = 0.0, cells: int = 1 << 22) -> DataFrame:
    """docs with lang_pred, score (share of the letters that lang_pred labels, 0 to 1)
    and spans (start, end in code points, lang) of runs of words of one language.

    Null, empty and letterless texts get `und`, 0.0 and no spans; so does every text
    if the model learned no language. Ties go to the first language by name. Columns
    of docs that clash with the results are replaced. With `only`, rows are kept whose
    language is in it and whose score is at least min_score, and no column is added.
    """
    shared = share(docs.sparkSession, model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)]

    built: list = []

    def label(column):
        model = shared()
        languages = len(model.languages)
        n = len(column)
        if not built:
            built.append(letter_tables())
        tables = built[0]
        data, offsets = utf8(column)
        mass = np.zeros((n, max(1, languages)))
        span_doc, span_start, span_end, span_lang = [], [], [], []
        parts: list[tuple[Words, np.ndarray]] = []

        def flush():
            if not parts:
                return
            doc, start, end = (np.concatenate([getattr(w, c) for w, _ in parts]) for c in ("doc", "start", "end"))
            scores = np.concatenate([s for _, s in parts])
            parts.clear()
            if not len(doc):
                return
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            labels = viterbi(scores, first, np.diff(np.append(first, len(doc))), model.switch)
            np.add.at(mass, (doc, labels), end - start)
            run = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])]))
            span_doc.append(doc[run])
            span_start.append(start[run])
            span_end.append(end[np.append(run[1:], len(doc)) - 1])
            span_lang.append(labels[run])

        waiting = 0
        for i, j in slices(offsets, 1 << 19) if languages else ():
            w = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables)
            w.doc += i
            parts.append((w, word_scores(w, model)))
            w.trigram = w.word = w.first = None
            waiting += len(w.doc) * languages
            if waiting > cells:
                flush()
                waiting = 0
        flush()
        total = mass.sum(axis=1)
        best = mass.argmax(axis=1)
        names = np.array([*model.languages, "und"], dtype=object)
        predicted = names[np.where(total > 0, best, -1)]
        score = np.divide(mass[np.arange(n), best], total, out=np.zeros(n), where=total > 0)
        if only is not None:
            return [pa.array((np.isin(predicted, only)) & (score >= min_score))]
        if span_doc:
            doc, start, end, lang = map(np.concatenate, (span_doc, span_start, span_end, span_lang))
        else:
            doc = start = end = lang = np.empty(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(names[lang.astype(np.int64)], pa.string())], names=["start", "end", "lang"])
        return [pa.array(predicted, pa.string()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)]

    if only is not None:
        return map_text(docs, text_col, keep, [], label, rows_too=True)
    return map_text(docs, text_col, keep, fields, label)
