"""Toxicity: bidirectional gated recurrent network with attention pooling over word and character inputs.

Every text is read in overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, to its end. Each word enters with a word part
(a trained vector and how much more often the word stands in toxic documents) and a character part (the mean of trained
vectors of its n-grams, and the strongest and mean of their rates). Two gated recurrent passes, attention over their states
and a logistic unit score the window; the document takes its worst window, calibrated to the share of toxic rows.

Trained in numpy on a bounded sample of whole labelled documents (about ``TOXIC`` and ``CLEAN``) from rows whose crc32(doc_id)
mod 4 is not 2. Rates come from one half and the network from the other, so it sees rates as they are on new text. Only
documents are labelled, so each epoch learns from the windows that the network finds worst, and from random clean ones.
Training starts ``STARTS`` times; of all epochs of all starts the one with the least loss on the calibration part is kept, so a start
that goes astray, or an epoch that overfits, does not count.

Defined cases: null, empty and wordless texts score 0; without labelled rows of both kinds every score is the share
of toxic rows (0 without any); null ids are scored, never learned from; several labels of an id count as toxic if one
is; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import held_out, keep_rows, map_arrow, pieces, texts
from larder.llm.word_table import WordTable, ngrams, per_word, table_of, word_buckets

THRESHOLD = 0.3
TOXIC, CLEAN = 1_500, 3_000
WINDOW, STRIDE = 24, 12
BUCKETS, SIZES = 1 << 17, (3, 4, 5)
OFTEN = 8  # documents in which a word or n-gram must stand to get a trained vector
WORD, CHAR, HIDDEN = 5, 5, 8
RATES = 3
SPLIT = (0.45, 0.4, 0.15)  # of the sample: rates, network, calibration
STARTS, EPOCHS, BY_RATES, BATCH, RATE = 3, 6, 2, 128, 0.015
SHRINK = 8.0
SLICE = 10_000  # words handled at once in training, a memory setting
SEED = 5


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word among all words, length) of the windows of each text; one empty window for a text without words."""
    number = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(counts)), number)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    start = step * STRIDE
    begin = np.cumsum(counts) - counts
    return owner, begin[owner] + start, np.minimum(WINDOW, counts[owner] - start)


class Network:
    """Weights; ``inputs`` makes a word's input, ``project`` what the gates add for it, ``score`` the logits of windows."""

    def __init__(self, share: float, seed=SEED):
        random = np.random.default_rng(seed)
        size = RATES + WORD + CHAR
        normal = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.share = share
        self.word_rate, self.gram_rate = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
        self.word_often, self.gram_often = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
        self.p = {
            "word": (random.standard_normal((BUCKETS, WORD)) * 0.05).astype(np.float32),
            "char": (random.standard_normal((BUCKETS, CHAR)) * 0.05).astype(np.float32),
            "inside": normal(size, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, np.float32),
            "gates_f": normal(HIDDEN, 2 * HIDDEN), "state_f": normal(HIDDEN, HIDDEN),
            "gates_b": normal(HIDDEN, 2 * HIDDEN), "state_b": normal(HIDDEN, HIDDEN),
            "look": normal(2 * HIDDEN, HIDDEN), "query": normal(HIDDEN), "out": normal(2 * HIDDEN), "shift": np.zeros(1, np.float32),
        }
        self.calibration = (1.0, 0.0)

    def features(self, words: list[str]):
        parts = ngrams(words, SIZES, BUCKETS)
        bucket, owner = np.concatenate([b for b, _ in parts]), np.concatenate([o for _, o in parts])
        order = np.argsort(owner, kind="stable")
        return word_buckets(words, BUCKETS), bucket[order].astype(np.int32), owner[order].astype(np.int32)

    def inputs(self, whole, bucket, owner) -> np.ndarray:
        n = len(whole)
        number = np.maximum(np.bincount(owner, minlength=n), 1)[:, None].astype(np.float32)
        rate = self.gram_rate[bucket]
        return np.concatenate([
            self.word_rate[whole, None], per_word(rate, owner, n, np.maximum)[:, None], per_word(rate, owner, n)[:, None] / number,
            self.p["word"][whole] * self.word_often[whole, None], per_word(self.p["char"][bucket] * self.gram_often[bucket, None], owner, n) / number,
        ], axis=1)

    def project(self, words: list[str]) -> np.ndarray:
        return self.inputs(*self.features(words)) @ self.p["inside"] + self.p["bias"]

    def one_way(self, rows, mask, gates, state, keep):
        """States of one direction; ``keep`` gets what the backward pass needs."""
        h = np.zeros((rows.shape[1], HIDDEN), np.float32)
        out = np.empty((*rows.shape[:2], HIDDEN), np.float32)
        for t in range(len(rows)):
            x, m = rows[t], mask[t]
            zr = sigmoid(x[:, : 2 * HIDDEN] + h @ gates)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ state)
            new = h + m * z * (c - h)
            if keep is not None:
                keep.append((h, z, r, c))
            h = out[t] = new
        return out

    def forward(self, table, at, lengths, keep=None):
        """Logits of windows; ``at`` (WINDOW, n) are rows of ``table``, the last row standing for padding."""
        p = self.p
        mask = (np.arange(WINDOW)[:, None] < lengths).astype(np.float32)[:, :, None]
        rows = table[at]
        ahead = self.one_way(rows[:, :, : 3 * HIDDEN], mask, p["gates_f"], p["state_f"], None if keep is None else keep["f"])
        back = self.one_way(rows[::-1, :, 3 * HIDDEN :], mask[::-1], p["gates_b"], p["state_b"], None if keep is None else keep["b"])[::-1]
        states = np.concatenate([ahead, back], axis=2)
        looked = np.tanh(states @ p["look"])
        weight = np.exp(looked @ p["query"]) * mask[:, :, 0]
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep.update(mask=mask, states=states, looked=looked, weight=weight, pooled=pooled)
        return pooled @ p["out"] + p["shift"][0]

    def score_windows(self, table, codes, start, lengths, block=4_000) -> np.ndarray:
        """Logits of windows over the words ``codes`` (rows of ``table``)."""
        codes = np.append(codes, np.zeros(WINDOW, codes.dtype))
        out = np.empty(len(start), np.float32)
        for i in range(0, len(start), block):
            at = codes[start[i : i + block] + np.arange(WINDOW)[:, None]]
            out[i : i + block] = self.forward(table, at, lengths[i : i + block])
        return out

    def probability(self, logit):
        slope, shift = self.calibration
        return sigmoid(slope * logit.astype(np.float64) + shift)


def gradients(net: Network, table, at, lengths, wrong, keep):
    """Gradients of all dense weights and of the rows of ``table``, from the error ``wrong`` of each window's logit."""
    p, g = net.p, {}
    states, weight, looked, mask = keep["states"], keep["weight"], keep["looked"], keep["mask"]
    g["shift"], g["out"] = np.array([wrong.sum()]), keep["pooled"].T @ wrong
    pooled = wrong[:, None] * p["out"]
    d_states = weight[:, :, None] * pooled
    d_weight = (states * pooled).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["query"] = np.einsum("tn,tnh->h", d_score, looked)
    d_looked = d_score[:, :, None] * p["query"] * (1 - looked**2)
    g["look"] = np.einsum("tns,tnh->sh", states, d_looked)
    d_states += d_looked @ p["look"].T
    d_rows = np.zeros((*at.shape, 6 * HIDDEN), np.float32)
    for side, kept, order, first in (("f", keep["f"], 1, 0), ("b", keep["b"], -1, 1)):
        gates, state = p[f"gates_{side}"], p[f"state_{side}"]
        d_out = d_states[::order, :, first * HIDDEN : (first + 1) * HIDDEN]
        d_x = d_rows[::order, :, 3 * HIDDEN * first : 3 * HIDDEN * (first + 1)]
        g_gates, g_state, carried = np.zeros_like(gates), np.zeros_like(state), np.zeros_like(d_out[0])
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, c = kept[t]
            d = d_out[t] + carried
            m = mask[::order][t]
            d_z, d_c = d * m * (c - h) * z * (1 - z), d * m * z * (1 - c**2)
            d_rh = d_c @ state.T
            d_r = d_rh * h * r * (1 - r)
            both = np.concatenate([d_z, d_r], axis=1)
            g_gates += h.T @ both
            g_state += (r * h).T @ d_c
            d_x[t] = np.concatenate([both, d_c], axis=1)
            carried = d * (1 - m * z) + d_rh * r + both @ gates.T
        g[f"gates_{side}"], g[f"state_{side}"] = g_gates, g_state
    return g, d_rows


class Adam:
    def __init__(self, params):
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}
        self.t = 0

    def step(self, params, grads, rate=RATE):
        self.t += 1
        size = rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for name, (at, g) in grads.items():
            m, v = self.m[name], self.v[name]
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.999 * v[at] + 0.001 * g * g
            params[name][at] -= size * m[at] / (np.sqrt(v[at]) + 1e-8)


def summed(at, values):
    rows, inverse = np.unique(at, return_inverse=True)
    return rows, np.stack([np.bincount(inverse, values[:, k], len(rows)) for k in range(values.shape[1])], 1).astype(np.float32)


def learn_rates(net: Network, codes, owner, labels, whole, bucket, gram_starts) -> None:
    """Log-odds of standing in a toxic document, shrunk, for words and n-grams hashed to buckets."""
    prior, size, docs = labels.mean(), codes.max(initial=0) + 1, len(labels)
    tables = np.zeros((2, 2, BUCKETS))  # words and n-grams; clean and toxic documents
    bounds = np.searchsorted(owner, np.arange(0, docs + 50, 50))
    for a, b in zip(bounds, bounds[1:]):
        pairs = np.unique(owner[a:b].astype(np.int64) * size + codes[a:b])
        doc, word = pairs // size, pairs % size
        doc, word = doc[word > 0], word[word > 0] - 1
        number = gram_starts[word + 1] - gram_starts[word]
        at = np.repeat(gram_starts[word], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        for table, buckets, documents in ((tables[0], whole[word], doc), (tables[1], bucket[at], np.repeat(doc, number))):
            seen = np.unique(documents.astype(np.int64) * BUCKETS + buckets)
            for kind in (0, 1):
                table[kind] += np.bincount(seen[labels[seen // BUCKETS] == kind] % BUCKETS, minlength=BUCKETS)
    (net.word_rate, net.word_often), (net.gram_rate, net.gram_often) = (
        (
            (np.log((toxic + SHRINK * prior) / (clean + SHRINK * (1 - prior))) - np.log(prior / (1 - prior))).astype(np.float32),
            (toxic + clean >= OFTEN).astype(np.float32),
        )
        for clean, toxic in tables
    )


def calibrated(logits, labels, weights, rounds=60):
    """Slope and shift of a logistic curve over the documents' worst windows, by Newton steps; ``weights`` undo the sampling."""
    x, b = np.stack([logits, np.ones_like(logits)], 1).astype(np.float64), np.zeros(2)
    for _ in range(rounds):
        q = sigmoid(x @ b)
        hessian = (x * (weights * q * (1 - q))[:, None]).T @ x + np.eye(2) * 1e-2
        b += np.clip(np.linalg.solve(hessian, x.T @ (weights * (labels - q)) - 1e-2 * b), -2, 2)
    return float(b[0]), float(b[1])


def fit(rows: list[tuple[str, int]], share: float) -> Network:
    """Train on (text, toxic) rows; ``share`` is the share of toxic rows that these were sampled from."""
    net, random = Network(share), np.random.default_rng(SEED)
    labels = np.array([y for _, y in rows], np.float64)
    if len(rows) < 8 or labels.min(initial=1) == labels.max(initial=0):
        net.calibration = (0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share else -30.0))
        return net
    shuffled = random.permutation(len(rows))
    words = WordTable(lambda new: np.zeros((len(new), 1)), 1, most=float("inf"))  # the sample is bounded; its codes stay valid
    found = [words.codes([rows[i][0] for i in shuffled[k : k + 100]]) for k in range(0, len(rows), 100)]
    codes, counts = (np.concatenate(x) for x in zip(*found))
    labels = labels[shuffled]
    vocabulary = [w for w in words.known if w]
    parts_of = [(i, net.features(vocabulary[i : i + SLICE])) for i in range(0, len(vocabulary), SLICE)]
    whole, bucket = (np.concatenate([x[k] for _, x in parts_of]) for k in (0, 1))
    gram_owner = np.concatenate([x[2] + np.int32(i) for i, x in parts_of])
    del parts_of
    gram_starts = np.append(0, np.cumsum(np.bincount(gram_owner, minlength=len(vocabulary))))
    parts = np.split(np.arange(len(rows)), np.cumsum([int(x * len(rows)) for x in SPLIT[:2]]))
    if any(labels[part].min(initial=1) == labels[part].max(initial=0) for part in parts):
        parts = [np.arange(len(rows))] * 3  # too few rows for parts of their own
    begin = np.cumsum(counts) - counts

    def words_of(part):
        at = np.repeat(begin[part], counts[part]) + np.arange(counts[part].sum()) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
        return codes[at], counts[part], labels[part]

    rate_codes, rate_counts, rate_labels = words_of(parts[0])
    learn_rates(net, rate_codes, np.repeat(np.arange(len(rate_counts)), rate_counts), rate_labels, whole, bucket, gram_starts)
    held = words_of(parts[2])
    held_doc, held_start, held_lengths = windows(held[1])
    held_weights = np.where(held[2] > 0, share / held[2].mean(), (1 - share) / (1 - held[2].mean()))
    codes, counts, labels = words_of(parts[1])
    doc, start, lengths = windows(counts)
    firsts = np.searchsorted(doc, np.arange(len(counts) + 1))

    def table(net):
        out = np.zeros((len(vocabulary) + 1, 6 * HIDDEN), np.float32)
        for i in range(0, len(vocabulary), SLICE):
            last = min(i + SLICE, len(vocabulary))
            grams = slice(gram_starts[i], gram_starts[last])
            out[i + 1 : last + 1] = net.inputs(whole[i:last], bucket[grams], gram_owner[grams] - np.int32(i)) @ net.p["inside"] + net.p["bias"]
        return out

    def worst(logits):
        order = np.lexsort((logits, doc))
        return order[firsts[1:] - 1]

    def judged(net, rows):
        """Loss on the calibration part after calibration, and the calibration."""
        top = np.full(len(held[1]), -np.inf)
        np.maximum.at(top, held_doc, net.score_windows(rows, held[0], held_start, held_lengths))
        slope, shift = calibrated(top, held[2], held_weights)
        q = np.clip(sigmoid(slope * top + shift), 1e-9, 1 - 1e-9)
        return -float((held_weights * (held[2] * np.log(q) + (1 - held[2]) * np.log(1 - q))).mean()), (slope, shift)

    padded = np.append(codes, np.zeros(WINDOW, codes.dtype))
    # The first choices of windows go by rates alone: the network has learned too little yet.
    by_rate = np.append(0, np.maximum(net.word_rate[whole], per_word(net.gram_rate[bucket], gram_owner, len(vocabulary), np.maximum)))
    first_logits = np.empty(len(start))
    for i in range(0, len(start), 20_000):
        inside = np.arange(WINDOW)[:, None] < lengths[i : i + 20_000]
        first_logits[i : i + 20_000] = np.where(inside, by_rate[padded[start[i : i + 20_000] + np.arange(WINDOW)[:, None]]], 0).max(axis=0)

    def learn(net, adam, logits, rate):
        """One epoch."""
        clean = np.flatnonzero(labels[doc] == 0)
        chosen = np.unique(np.concatenate([worst(logits), random.choice(clean, min(len(clean), 2 * len(counts)), replace=False)]))
        random.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            part = chosen[i : i + BATCH]
            at = padded[start[part] + np.arange(WINDOW)[:, None]]
            used, local = np.unique(at, return_inverse=True)
            real = used > 0
            index = used[real] - 1
            number = gram_starts[index + 1] - gram_starts[index]
            grams = bucket[np.repeat(gram_starts[index], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)]
            grams_of = np.repeat(np.arange(len(index)), number)
            x = np.zeros((len(used), RATES + WORD + CHAR), np.float32)
            x[real] = net.inputs(whole[index], grams, grams_of)
            rows_of = x @ net.p["inside"] + net.p["bias"] * real[:, None]
            keep = {"f": [], "b": []}
            logit = net.forward(rows_of.astype(np.float32), local.reshape(at.shape), lengths[part], keep)
            wrong = ((sigmoid(logit) - labels[doc[part]]) / len(part)).astype(np.float32)
            g, d_rows = gradients(net, rows_of, at, lengths[part], wrong, keep)
            _, d_word = summed(np.append(local.ravel(), np.arange(len(used))), np.concatenate([d_rows.reshape(-1, 6 * HIDDEN), np.zeros((len(used), 6 * HIDDEN))]))
            d_word *= real[:, None]
            g["inside"], g["bias"] = x.T @ d_word, d_word.sum(axis=0)
            d_x = (d_word @ net.p["inside"].T)[real]
            updates = {k: (slice(None), v.astype(np.float32)) for k, v in g.items()}
            updates["word"] = summed(whole[index], d_x[:, RATES : RATES + WORD] * net.word_often[whole[index], None])
            updates["char"] = summed(grams, d_x[grams_of, RATES + WORD :] / number[grams_of, None] * net.gram_often[grams, None])
            adam.step(net.p, updates, rate)

    best = float("inf")
    for attempt in range(STARTS):
        trial = Network(share, SEED + attempt)
        trial.word_rate, trial.word_often, trial.gram_rate, trial.gram_often = net.word_rate, net.word_often, net.gram_rate, net.gram_often
        adam, logits = Adam(trial.p), first_logits
        for epoch in range(EPOCHS):
            learn(trial, adam, logits, RATE * (1 - 0.8 * epoch / EPOCHS))
            if epoch + 1 >= BY_RATES:
                rows_now = table(trial)
                loss, calibration = judged(trial, rows_now)
                if loss < best:
                    best, net.calibration, net.p = loss, calibration, {k: v.copy() for k, v in trial.p.items()}
                if epoch + 1 < EPOCHS:
                    logits = trial.score_windows(rows_now, codes, start, lengths)
                del rows_now
    return net


def document_scores(net: Network, batch: list[str], table: WordTable) -> np.ndarray:
    codes, counts = table.codes(batch)
    doc, start, lengths = windows(counts)
    logits = net.score_windows(table.rows, codes, start, lengths)
    out = np.full(len(batch), -np.inf, np.float32)
    np.maximum.at(out, doc, logits)
    return np.where(counts > 0, net.probability(out), 0.0)


def training_rows(docs: DataFrame, labels: DataFrame, toxic=TOXIC, clean=CLEAN) -> tuple[list[tuple[str, int]], float]:
    """The bounded sample of labelled documents, chosen by hash, and the share of toxic rows among all of them."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = marked.where(~held_out())
    number = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = lambda kind, most: int(min(1.0, most / max(number.get(kind, 0), 1)) * (1 << 30))
    chosen = known.where(((F.col("toxic") == 1) & (chance < limit(1, toxic))) | ((F.col("toxic") == 0) & (chance < limit(0, clean))))
    # The sample is bounded (about ``toxic`` + ``clean`` rows), so its ids may be broadcast: no text is shuffled.
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.select("doc_id", "toxic").collect()], "doc_id LONG, toxic INT")
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(~held_out() & F.col("text").isNotNull())
    rows = sorted((r["text"], r["toxic"]) for r in texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic").collect())
    return rows, number.get(1, 0) / max(sum(number.values()), 1)


def word_table(shared):
    """The broadcast network and this process's word table for it."""
    net = shared.value
    return net, table_of(net, net.project, 6 * HIDDEN)


def keep_clean(df: DataFrame, net: Network, threshold=THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose score is below ``threshold``."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    def decide(batch):
        net, table = word_table(shared)
        return document_scores(net, batch, table) < threshold

    return keep_rows(df, decide)


def score(df: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) per row."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    def work(batches):
        net, table = word_table(shared)
        for batch in (piece for whole in batches for piece in pieces(whole, 1_000)):
            yield {"doc_id": batch.column("doc_id"), "score": document_scores(net, texts(batch), table)}

    return map_arrow(df.select(F.col("doc_id").cast("long"), "text"), work, "doc_id LONG, score DOUBLE")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled training rows and score all documents."""
    found = score(docs, fit(*training_rows(docs, labels)))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
