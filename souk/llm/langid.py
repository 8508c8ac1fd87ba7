"""Language identification with segmentation-marginalised unigrams.

For every language a unigram distribution over the pieces of a fixed public
vocabulary is learned; a word's probability is the sum over *all* its
segmentations into pieces, computed by a forward algorithm, and a text's is the
product over its words. The predicted language has the greatest likelihood,
``score`` is its posterior under equal priors.

Words are maximal letter runs of the lower-cased text, each with the vocabulary's
word-start mark in front. Training reads a sample of the labelled rows, bounded
by ``SAMPLE_DOCS`` documents per language in expectation (chosen by a hash of
doc_id and text, all of them where there are fewer) and ``TYPES_PER_LANGUAGE``
word types; piece probabilities come from expectation-maximisation over the
word types: forward and backward sums give the expected uses of each piece over
all segmentations. Scoring reads every document whole.

Cases: null text, or a text without any letter, is ``und`` with score 0; ties go
to the alphabetically first language; a letter outside the vocabulary has the
same small probability in each language; with no labelled row everything is
``und``. doc_id may repeat or be null; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import crc_of_id, held, ship, small_batches

SAMPLE_DOCS = 300            # training documents per language, in expectation
TYPES_PER_LANGUAGE = 50_000  # most frequent word types of a language's sample
EM_ROUNDS = 4
SMOOTHING = 0.05             # pseudo-count of every piece in every language
UNKNOWN_LOG = -14.0          # natural log probability of a letter without a piece
CACHE_WORDS = 200_000
LONGEST_WORD = 64            # longer letter runs are scored in parts of this length
#: Numbers that are no decimal digits (superscripts, fractions, Roman and circled ones) count as
#: word characters in Python; with them and the digits taken out, Unicode's letters are left.
NUMERALS = "".join(chr(c) for c in range(0x20000) if unicodedata.category(chr(c)) in ("Nl", "No"))
WORD = re.compile(rf"[^\W\d_{''.join(c for c in NUMERALS if c <= chr(0xFFFF))}]+")
#: The same for texts with characters above U+FFFF (slow there, so only used for them).
HIGH = re.compile("[\U00010000-\U0010ffff]")
WORD_HIGH = re.compile(rf"[^\W\d_{NUMERALS}]+")
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return (WORD_HIGH if HIGH.search(text) else WORD).findall(text.lower())


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    pieces: tuple[str, ...]          # word-start mark written as a blank
    log_p: np.ndarray                # (pieces, languages), natural logs


class Lattice:
    """All matches of pieces in a list of words, as flat arrays by end position."""

    def __init__(self, matches, words: list[str]):
        texts = [" " + w for w in words]
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        word, end, size, piece = [], [], [], []
        for k, t in enumerate(texts):
            for e, (n, i) in matches(t):
                word.append(k)
                end.append(e + 1)
                size.append(n)
                piece.append(i)
        word, end = np.array(word, np.int64), np.array(end, np.int64)
        order = np.lexsort((word, end))
        self.word, self.end = word[order], end[order]
        self.start = self.end - np.array(size, np.int64)[order]
        self.piece = np.array(piece, np.int64)[order]
        top = int(self.lengths.max(initial=0))
        self.cuts = np.searchsorted(self.end, np.arange(top + 2))
        self.n, self.top = len(texts), top

    def forward(self, p: np.ndarray, unknown: float) -> np.ndarray:
        """alpha[pos, word, language]: probability of the first ``pos`` characters
        (as scaled values exp(log_p) -- words are short, so no rescaling)."""
        alpha = np.zeros((self.top + 1, self.n, p.shape[1]))
        alpha[0] = 1.0
        for pos in range(1, self.top + 1):
            a, b = self.cuts[pos], self.cuts[pos + 1]
            alpha[pos] = alpha[pos - 1] * unknown
            if a < b:
                part = alpha[self.start[a:b], self.word[a:b]] * p[self.piece[a:b]]
                first = np.concatenate(([0], np.nonzero(np.diff(self.word[a:b]))[0] + 1))
                alpha[pos, self.word[a:b][first]] += np.add.reduceat(part, first, axis=0)
        return alpha

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.lengths, np.arange(self.n)]

    def expected(self, p: np.ndarray, unknown: float, counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece (pieces, languages) over all segmentations;
        ``counts`` (words, languages)."""
        alpha = self.forward(p, unknown)
        beta = np.zeros_like(alpha)
        beta[self.lengths, np.arange(self.n)] = 1.0
        uses = np.zeros_like(p)
        weight = counts / np.maximum(self.totals(alpha), 1e-300)
        for pos in range(self.top, 0, -1):
            a, b = self.cuts[pos], self.cuts[pos + 1]
            beta[pos - 1] += beta[pos] * unknown
            if a < b:
                w, s, i = self.word[a:b], self.start[a:b], self.piece[a:b]
                out = p[i] * beta[pos, w]
                np.add.at(uses, i, alpha[s, w] * out * weight[w])
                np.add.at(beta, (s, w), out)
        return uses


def _automaton(pieces: tuple[str, ...]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for i, p in enumerate(pieces):
        auto.add_word(p, (len(p), i))
    auto.make_automaton()
    return auto.iter


def usable_pieces(model_file: str) -> tuple[str, ...]:
    """Pieces of the public vocabulary that can occur in a lower-cased word."""
    from souk.llm.pieces import SPACE, Vocabulary

    v = Vocabulary.load(model_file)
    out = {p.replace(SPACE, " ") for p, k in zip(v.pieces, v.kinds) if k == "n"}
    return tuple(sorted(p for p in out if re.fullmatch(r" ?[^\W\d_]*", p) and p == p.lower() and p))


def train(rows: list[tuple[str, str, int]], pieces: tuple[str, ...]) -> Model:
    """Piece probabilities from (language, word, count) rows."""
    languages = tuple(sorted({r[0] for r in rows}))
    types = sorted({r[1] for r in rows})
    at_w, at_l = {w: k for k, w in enumerate(types)}, {x: k for k, x in enumerate(languages)}
    counts = np.zeros((len(types), len(languages)))
    for lang, word, n in rows:
        counts[at_w[word], at_l[lang]] += n
    matches = _automaton(pieces)
    blocks = [(Lattice(matches, types[k:k + 8192]), counts[k:k + 8192]) for k in range(0, len(types), 8192)]
    p = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(EM_ROUNDS):
        uses = np.full_like(p, SMOOTHING)
        for lattice, n in blocks:
            uses += lattice.expected(p, float(np.exp(UNKNOWN_LOG)), n)
        p = uses / uses.sum(axis=0)
    return Model(languages, pieces, np.log(p))


class Scorer:
    """Word log-likelihoods of one model, kept per worker in a bounded table."""

    def __init__(self, model: Model, limit: int = CACHE_WORDS):
        self.model, self.limit = model, limit
        self.matches = _automaton(model.pieces)
        self.p = np.exp(model.log_p)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def _add(self, words: list[str]) -> None:
        if len(self.rows) + len(words) > self.limit:
            self.rows.clear()
            self.table = self.table[:0]
        out = []
        for k in range(0, len(words), 4096):
            block = sorted(words[k:k + 4096], key=len)
            for j in range(0, len(block), 512):          # words of about equal length together
                part = block[j:j + 512]
                lattice = Lattice(self.matches, part)
                total = lattice.totals(lattice.forward(self.p, float(np.exp(UNKNOWN_LOG))))
                out.append(np.log(np.maximum(total, 1e-300)))
                self.rows.update(zip(part, range(len(self.rows), len(self.rows) + len(part))))
        self.table = np.concatenate([self.table, *out])

    def log_likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) log-likelihoods and the number of words of each text."""
        sums = np.zeros((len(texts), len(self.model.languages)))
        lengths = np.zeros(len(texts), np.int64)
        k = 0
        while k < len(texts):                            # blocks of texts with a bounded number of words
            flat: list[str] = []
            start = k
            while k < len(texts) and len(flat) < 200_000:
                w = words_of(texts[k])
                lengths[k] = len(w)
                flat += w
                k += 1
            if any(len(w) > LONGEST_WORD for w in set(flat)):
                parts, owner = [], []
                for j, w in zip(np.repeat(np.arange(start, k), lengths[start:k]), flat):
                    for a in range(0, len(w), LONGEST_WORD):
                        parts.append(w[a:a + LONGEST_WORD])
                        owner.append(j)
                flat, owner = parts, np.array(owner, np.int64)
            else:
                owner = np.repeat(np.arange(start, k), lengths[start:k])
            for a in range(0, len(flat), self.limit // 2):
                piece = flat[a:a + self.limit // 2]
                fresh = list(set(piece).difference(self.rows))
                if fresh:
                    if len(self.rows) + len(fresh) > self.limit:
                        self.rows.clear()
                        self.table = self.table[:0]
                        fresh = list(set(piece))
                    self._add(sorted(fresh))
                at = np.fromiter(map(self.rows.__getitem__, piece), np.int64, len(piece))
                values = self.table[at]
                for c in range(values.shape[1]):
                    sums[:, c] += np.bincount(owner[a:a + len(piece)], values[:, c], len(texts))
        return sums, lengths

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.model.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        sums, lengths = self.log_likelihoods(texts)
        best = sums.argmax(axis=1)
        top = sums[np.arange(len(texts)), best]
        post = 1.0 / np.exp(sums - top[:, None]).sum(axis=1)
        return ([self.model.languages[b] if n else UNDETERMINED for b, n in zip(best, lengths)],
                [float(x) if n else 0.0 for x, n in zip(post, lengths)])


def training_counts(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS,
                    types: int = TYPES_PER_LANGUAGE) -> list[tuple[str, str, int]]:
    """(language, word, count) of a bounded sample of labelled rows (text, lang, doc_id)."""
    rows = labelled.filter("lang is not null and text is not null")
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_lang:
        return []
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    share = F.create_map(*[x for lang, n in per_lang.items()
                           for x in (F.lit(lang), F.lit(int(1_000_000 * min(1.0, sample_docs / n))))])
    sample = rows.filter(draw < share[F.col("lang")])
    words = sample.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '(\\p{L}+)', 1)")).alias("w"))
    words = words.filter(F.length("w") <= LONGEST_WORD)
    counted = words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    return [(r["lang"], r["w"], r["n"]) for r in
            counted.withColumn("rk", best).filter(F.col("rk") <= types).collect()]


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return crc_of_id(doc_id) % folds == fold


def fit(docs: DataFrame, model_file: str, train_on: Column | None = None, **bounds) -> Model:
    labelled = docs.select("doc_id", "text", "lang")
    counts = training_counts(labelled.filter(train_on) if train_on is not None else labelled, **bounds)
    pieces = usable_pieces(model_file)
    return train(counts, pieces) if counts else Model((), pieces, np.zeros((len(pieces), 0)))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) with lang_pred and score of every row."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    keep = keep or ["doc_id"]
    shared = spark.sparkContext.broadcast(model)         # fixed size: pieces x languages
    key = f"langid-{uuid.uuid4().hex}"
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        import pyarrow as pa

        scorer = held(key, lambda: Scorer(shared.value))
        for batch in batches:
            lang, score = scorer.predict(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{fields}, lang_pred string, score double")


def language_of(model: Model, spark, cache_words: int = CACHE_WORDS):
    """A column function: struct (lang_pred, score) of a text column."""
    ship(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    key = f"langid-{uuid.uuid4().hex}"

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        lang, score = held(key, lambda: Scorer(shared.value, cache_words)).predict([t if isinstance(t, str) else None for t in text])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return predict
