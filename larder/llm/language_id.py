"""Language identification with a linear-chain conditional random field over the words of a text.

A word's evidence comes from hashed character n-grams (those at the word's edges are its affixes), from the whole word and from
lexicons of the most frequent words per language. Transitions between the languages of neighbouring words are learned from
sequences that switch between documents of different languages. Forward-backward gives each word a distribution over
languages, so text that mixes languages is labelled word by word; the document takes the language with the largest mean.

The model is fitted in numpy on a bounded sample: about ``PER_LANGUAGE`` whole documents per language, from the rows whose
crc32(doc_id) mod 4 is not 2. Only text and lang of these rows are used.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any training row every text is; null ids are
scored but never learned from; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import held_out, keep_rows, map_arrow, pieces, texts
from larder.llm.word_table import WordTable, ngrams, normal, per_word, table_of, word_buckets

UNDETERMINED = "und"
PER_LANGUAGE = 400
LEAST = 0.4  # score below which a filter takes a text to have no main language
BUCKETS = 1 << 16
SIZES = (2, 3, 4)
LEXICON = 1_000
SEQUENCE, SEQUENCES, EPOCHS, BATCH, RATE = 40, 2_400, 3, 60, 0.3
SLICE = 5_000  # distinct words whose n-grams are made at once; a setting of memory
SEED = 11


class Crf:
    """Weights of one model; small enough to be broadcast (the tables have a fixed number of buckets)."""

    def __init__(self, languages: list[str], lexicon: list[str], member: np.ndarray):
        n = len(languages)
        self.languages, self.lexicon, self.member = languages, {w: i for i, w in enumerate(lexicon)}, member
        self.gram = np.zeros((BUCKETS, n), np.float32)
        self.word = np.zeros((BUCKETS, n), np.float32)
        self.lexical = np.zeros((n, n), np.float32)
        self.transition = np.zeros((n, n), np.float32)

    def features(self, words: list[str]):
        """N-gram buckets with their words, whole-word buckets, lexicon membership."""
        parts = ngrams(words, SIZES, BUCKETS)
        rows = [self.lexicon.get(w, -1) for w in words]
        member = np.array([self.member[r] if r >= 0 else np.zeros(len(self.languages)) for r in rows], np.float32).reshape(len(words), len(self.languages))
        return parts, word_buckets(words, BUCKETS), member

    def evidence(self, words: list[str]) -> np.ndarray:
        parts, whole, member = self.features(words)
        out = self.word[whole] + member @ self.lexical
        for bucket, owner in parts:
            out += per_word(self.gram[bucket], owner, len(words))
        return out


def packed(counts: np.ndarray):
    """Order of documents by length, and the time-major place of each word: step by step, longest document first."""
    order = np.argsort(-counts, kind="stable")
    lengths = counts[order]
    running = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")  # documents longer than t
    first = np.cumsum(running) - running
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    owner = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return running, first, first[step] + rank[owner], owner


def forward_backward(evidence: np.ndarray, transition: np.ndarray, counts: np.ndarray, pairs=False):
    """Marginals of every word (and expected transitions); all documents advance together, one word per step."""
    running, first, place, owner = packed(counts)
    n = evidence.shape[1]
    scaled = np.empty_like(evidence)
    scaled[place] = np.exp(evidence - evidence.max(axis=1, keepdims=True)) if len(evidence) else evidence
    step_matrix = np.exp(transition - transition.max()).astype(evidence.dtype)
    alpha, beta = np.empty_like(scaled), np.ones_like(scaled)
    a = None
    for t, (m, f) in enumerate(zip(running.tolist(), first.tolist())):
        a = scaled[f : f + m] if t == 0 else (a[:m] @ step_matrix) * scaled[f : f + m]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[f : f + m] = a
    expected = np.zeros((n, n))
    for t in range(len(running) - 2, -1, -1):
        m, f, after = running[t + 1], first[t], first[t + 1]
        carried = scaled[after : after + m] * beta[after : after + m]
        b = carried @ step_matrix.T
        total = b.sum(axis=1, keepdims=True)
        if pairs:
            scale = 1 / (alpha[f : f + m] * b).sum(axis=1, keepdims=True)
            expected += (alpha[f : f + m] * scale).T @ carried * step_matrix
        beta[f : f + m] = b / total
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    return (marginal[place], expected) if pairs else marginal[place]


def fit(rows: list[tuple[str, str]]) -> Crf:
    """Train on (text, lang) rows by gradient steps on the likelihood of switching sequences."""
    random = np.random.default_rng(SEED)
    languages = sorted({lang for _, lang in rows})
    once: dict[str, str] = {}  # equal words are one object
    plain = lambda text: [once.setdefault(w, w) for w in map(normal, text.split()) if w]
    pool = {lang: [w for w in (plain(text) for text, x in rows if x == lang) if w] for lang in languages}
    pool = {lang: docs for lang, docs in pool.items() if docs}
    languages = sorted(pool)
    counts = [_counts(pool[lang]) for lang in languages]
    top = sorted({w for c in counts for w in sorted(c, key=lambda w: (-c[w], w))[:LEXICON]})
    seen = np.array([[c.get(w, 0) for c in counts] for w in top], np.float32).reshape(len(top), len(languages))
    model = Crf(languages, top, seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))
    if not languages:
        return model
    words = sorted({w for docs in pool.values() for doc in docs for w in doc})
    number = {w: i for i, w in enumerate(words)}
    coded = [[np.fromiter(map(number.__getitem__, doc), np.int32, len(doc)) for doc in pool[lang]] for lang in languages]
    del pool, once, counts, number
    grams, whole, member, sizes = (np.concatenate(x) for x in zip(*(_ordered_features(model, words[i : i + SLICE]) for i in range(0, len(words), SLICE))))
    starts = np.append(0, np.cumsum(sizes))
    squares = [np.full_like(x, 1e-3) for x in (model.gram, model.word, model.lexical, model.transition)]
    for _ in range(EPOCHS):
        for _ in range(SEQUENCES // BATCH):
            codes, labels = _sequences(coded, random)
            used, row = np.unique(codes, return_inverse=True)
            take = np.concatenate([np.arange(starts[w], starts[w + 1]) for w in used])
            owner = np.repeat(np.arange(len(used)), starts[used + 1] - starts[used])
            evidence = model.word[whole[used]] + member[used] @ model.lexical + per_word(model.gram[grams[take]], owner, len(used))
            marginal, expected = forward_backward(evidence[row].astype(np.float64), model.transition.astype(np.float64), np.full(BATCH, SEQUENCE), True)
            truth = np.zeros_like(marginal)
            truth[np.arange(len(labels)), labels] = 1
            change = np.stack([np.bincount(row, (truth - marginal)[:, k], len(used)) for k in range(len(languages))], 1)
            line = labels.reshape(BATCH, SEQUENCE)
            steps = np.zeros((len(languages),) * 2)
            np.add.at(steps, (line[:, :-1].ravel(), line[:, 1:].ravel()), 1)
            _step(model.gram, squares[0], grams[take], change[owner])
            _step(model.word, squares[1], whole[used], change)
            _step(model.lexical, squares[2], slice(None), member[used].T @ change)
            _step(model.transition, squares[3], slice(None), steps - expected)
    return model


def _ordered_features(model, words):
    """N-gram buckets word by word, whole-word buckets, lexicon membership, and the number of n-grams of each word."""
    parts, whole, member = model.features(words)
    owners = np.concatenate([o for _, o in parts])
    grams = np.concatenate([b for b, _ in parts])[np.argsort(owners, kind="stable")]
    return grams.astype(np.int32), whole, member, np.bincount(owners, minlength=len(words))


def _counts(docs):
    out: dict[str, int] = {}
    for doc in docs:
        for word in doc:
            out[word] = out.get(word, 0) + 1
    return out


def _sequences(coded, random):
    """A batch of word sequences, half of them switching between languages, and the language of each word."""
    codes, labels = [], []
    for _ in range(BATCH):
        left, lang = SEQUENCE, int(random.integers(len(coded)))
        switching = random.random() < 0.5
        while left:
            doc = coded[lang][int(random.integers(len(coded[lang])))]
            start = int(random.integers(len(doc)))
            part = doc[start : start + min(left, int(random.integers(4, 20)) if switching else left)]
            codes.append(part)
            labels.append(np.full(len(part), lang))
            left -= len(part)
            if switching:
                lang = int(random.integers(len(coded)))
    return np.concatenate(codes), np.concatenate(labels)


def _step(weights, squares, at, gradient):
    """Adaptive gradient step on the touched rows."""
    if isinstance(at, slice):
        total, rows = gradient, at
    else:
        rows, inverse = np.unique(at, return_inverse=True)
        total = np.stack([np.bincount(inverse, gradient[:, k], len(rows)) for k in range(gradient.shape[1])], 1)
    squares[rows] += total**2
    weights[rows] += RATE * total / np.sqrt(squares[rows])


def training_rows(df: DataFrame, per_language=PER_LANGUAGE) -> list[tuple[str, str]]:
    """The bounded sample: about ``per_language`` whole documents of each language, chosen by hash."""
    known = df.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().collect()  # one row per language
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    limit = F.lit(0)
    for row in counts:
        limit = F.when(F.col("lang") == row["lang"], F.lit(min(1 << 30, int(per_language / row["count"] * (1 << 30))))).otherwise(limit)
    return sorted((r["text"], r["lang"]) for r in known.where(chance < limit).select("text", "lang").collect())


def document_languages(model: Crf, batch: list[str], table: WordTable) -> tuple[list[str], list[float]]:
    n = len(model.languages)
    if not n:
        return [UNDETERMINED] * len(batch), [0.0] * len(batch)
    codes, counts = table.codes(batch)
    evidence = table.rows[codes]
    marginal = forward_backward(evidence, model.transition, counts)
    lettered = codes > 0
    owner = np.repeat(np.arange(len(batch)), counts)[lettered]
    sums = np.stack([np.bincount(owner, marginal[lettered, k], len(batch)) for k in range(n)], 1)
    total = np.bincount(owner, minlength=len(batch))
    best, found = sums.argmax(axis=1), total > 0
    score = np.where(found, sums[np.arange(len(batch)), best] / np.maximum(total, 1), 0.0)
    return [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), found.tolist())], np.clip(score, 0, 1)


def word_table(shared):
    """The broadcast model and this process's word table for it."""
    model = shared.value
    return model, table_of(model, model.evidence, len(model.languages))


def keep_identified(df: DataFrame, model: Crf, least=LEAST) -> DataFrame:
    """The rows of ``df`` whose text has a language with a score of ``least`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def decide(batch):
        model, table = word_table(shared)
        names, scores = document_languages(model, batch, table)
        return (np.array(names, object) != UNDETERMINED) & (np.asarray(scores) >= least)

    return keep_rows(df, decide)


def identify(df: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, lang_pred, score) per row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model, table = word_table(shared)
        for batch in (piece for whole in batches for piece in pieces(whole, 2_000)):
            names, scores = document_languages(model, texts(batch), table)
            yield {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores}

    return map_arrow(df.select(F.col("doc_id").cast("long"), "text"), work, "doc_id LONG, lang_pred STRING, score DOUBLE")


def predictions(df: DataFrame) -> DataFrame:
    """Fit on the training rows of ``df`` and label all of its rows."""
    found = identify(df, fit(training_rows(df)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
