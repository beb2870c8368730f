"""Toxicity by weak supervision (operator 6).

1. *Sample.* Labelled rows of the training folds, at most about ``SAMPLE`` of them (a hash of the id picks them).
2. *Voters.* A fixed lexicon of insults, prefixes of words mined from the sample by log-odds (they catch
   inflected and coined forms in any language), and patterns (shouting, exclamation marks, repeated words, table
   cells), and the sample's labels as one voter more. A voter says whether it fires on a text.
3. *Label model.* A latent class with one firing rate per voter and class, fitted by EM. The correlations of the
   voters within a class, taken from the posteriors, divide the weight of voters that repeat one another.
4. *Classifier.* A logistic regression on the voters' counts, single and pooled, trained on the label
   model's posteriors.

The sample and the model are of bounded size; all else runs over whole texts in Arrow tasks. Scores use the
text only. Null and empty texts score as texts on which nothing fires. Without usable labels every voter keeps
its starting rates and the fixed lexicon decides. Repeated rows score alike; an empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .shingles import _BYTE, _PLACE, fold, mix, signed, text_slices, word_spans

SAMPLE = 20_000       # labelled rows to learn from (a bound, met within the hash's spread)
PREFIXES = range(4, 13)
MINED = 300           # mined voters at most: the size of the model
MIN_ROWS = 5          # sample rows a mined prefix must occur in
PREDICT_AT = 0.7

#: fixed values: common insults
LEXICON = ("idiot moron stupid dumb loser scum trash garbage worthless pathetic disgusting clown fool bastard "
           "imbecile cretin retard bitch asshole shit fuck whore slut pig vermin parasite hate kill "
           "imbécile crétin connard salope débile merde ordure dégage abruti "
           "dummkopf arschloch idiotisch abschaum schwein miststück hurensohn scheiße wertlos "
           "imbécil estúpido basura cabrón puta mierda gilipollas asqueroso inútil").split()
PATTERNS = ("shouting", "exclamations", "repeats", "cells")


def _word_parts(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of the word prefixes of each length and the words they belong to, and the rows' offsets into the words."""
    plain = fold(data, digits=False)
    starts, ends, rows = word_spans(plain, off)
    hashes, owners = [], []
    total, word = np.zeros(len(starts), np.uint64), np.arange(len(starts))
    for k in range(PREFIXES[-1]):
        long = ends[word] - starts[word] > k
        word, total = word[long], total[long]
        total = total + _BYTE[plain[starts[word] + k]] * _PLACE[k]
        if k + 1 in PREFIXES:
            hashes.append(mix(total, k + 1))
            owners.append(word)
    return hashes, owners, rows


def prefix_hash(prefix: str) -> int:
    """Hash of a prefix as ``_word_parts`` makes it (its first bytes, if it is longer than all)."""
    data = fold(np.frombuffer(prefix.encode()[:PREFIXES[-1]], np.uint8))
    return int(mix(np.array([(_BYTE[data] * _PLACE[:len(data)]).sum(dtype=np.uint64)]), len(data))[0])


@dataclass(frozen=True)
class Model:
    """Everything a score needs: the voters' sorted prefix hashes, which of them are the fixed
    lexicon's, and the classifier's weights."""

    prefixes: np.ndarray
    fixed: np.ndarray
    weights: np.ndarray

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        x = inputs(*counts(self.prefixes, data, off), self.fixed)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def counts(prefixes: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each prefix (sorted hashes) in each row, and each row's pattern rates and words."""
    n, width = len(off) - 1, len(prefixes)
    hashes, owners, rows = _word_parts(data, off)
    words = np.diff(rows)
    row_of = np.repeat(np.arange(n), words)
    sieve = np.zeros(1 << 16, bool)
    sieve[(prefixes >> np.uint64(48)).astype(np.int64)] = True
    total = np.zeros(n * width, np.int64)
    for h, owner in zip(hashes, owners):
        hit = np.flatnonzero(sieve[(h >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(prefixes, h[hit])
        at[at == width] = 0
        same = prefixes[at] == h[hit] if width else np.zeros(0, bool)
        if same.any():
            total += np.bincount(row_of[owner[hit[same]]] * width + at[same], minlength=n * width)
    size = np.maximum(np.diff(off), 1)
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
    capital = per_row((data >= 65) & (data <= 90)) / size
    marks = per_row(data == 33) / np.maximum(words, 1)
    cells = per_row(data == 124) / np.maximum(words, 1)
    first = hashes[0] if hashes else np.zeros(0, np.uint64)
    again = np.zeros(n, np.int64)
    if len(first) > 1:
        run = (first[1:] == first[:-1]) & (np.diff(owners[0]) == 1)
        again = np.bincount(row_of[owners[0][1:]][run], minlength=n)
    return total.reshape(n, width), np.stack([capital, np.minimum(marks, 1), again / np.maximum(words, 1), np.minimum(cells, 1),
                                                  words], axis=1)


def inputs(found: np.ndarray, patterns: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Classifier inputs of rows: each voter's presence and log count, the same for the lexicon and for the
    mined prefixes as wholes with their shares of the words, the patterns, and a constant."""
    full = lambda n: np.log1p(np.minimum(n, 8))  # noqa: E731  more hits say no more
    pooled = []
    for part in (fixed, ~fixed):
        hits = found[:, part].sum(axis=1)
        pooled += [hits > 0, full(hits), np.minimum(10 * hits / np.maximum(patterns[:, -1], 10), 1), (found[:, part] > 0).sum(axis=1) > 1]
    return np.hstack([found > 0, full(found), np.stack(pooled, axis=1), patterns[:, :-1], np.ones((len(found), 1))]
                     ).astype(np.float64)


def votes(found: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Which voters fire on each row: every prefix, and each pattern above its usual rate."""
    return np.hstack([found > 0, patterns[:, :-1] > np.array([0.3, 0.2, 0.2, 0.2])]).astype(np.float64)


def label_model(fired: np.ndarray, start: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
    """Posterior of class 1 for each row. ``start``: firing rates (class, voter) to begin with."""
    rates, share = np.clip(start, 1e-4, 1 - 1e-4), np.clip(prior, 0.01, 0.9)
    weight = np.ones(fired.shape[1])
    q = np.full(len(fired), share)
    for step in range(rounds):
        fires, silent = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        logit = np.log(share / (1 - share)) + fired @ (weight * fires) + (1 - fired) @ (weight * silent)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        mass = np.stack([(1 - q).sum(), q.sum()])
        sums = np.stack([(1 - q) @ fired, q @ fired])
        # the starting rates count as five more rows of each class
        rates = np.clip((sums + 5 * np.clip(start, 1e-4, 1 - 1e-4)) / (mass[:, None] + 5), 1e-4, 1 - 1e-4)
        share = float(np.clip(q.mean(), 0.01, 0.9))
        if step in (0, rounds // 2):  # voters that fire together beyond their class count once between them
            rest = fired - np.outer(q, rates[1]) - np.outer(1 - q, rates[0])
            cov = rest.T @ rest
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            tied = np.maximum(cov / np.outer(spread, spread), 0)
            tied[tied < max(0.3, 3 / np.sqrt(len(fired)))] = 0  # chance
            np.fill_diagonal(tied, 1)
            weight = 1 / tied.sum(axis=1)
    return q


def linear_classifier(x: np.ndarray, q: np.ndarray, rounds: int = 12, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = np.maximum(p * (1 - p), 1e-4)
        w = w + np.linalg.solve((x * slope[:, None]).T @ x + np.diag(penalty), x.T @ (q - p) - penalty * w)
    return w


def held_out(id_col: str) -> Column:
    """Rows of the fold that is never learnt from (a null id is not in it)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int) -> DataFrame:
    """(text, label) of about ``size`` training rows at most; labels of one id count once, the largest."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label")))
    share = min(1.0, size / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # the sample is bounded by `size`, so the broadcast is too
    return texts.join(F.broadcast(picked), "_id").select(F.col("_text").alias("text"), F.col("_label").alias("label"))


def mine_prefixes(sample: DataFrame, totals: tuple[int, int]) -> np.ndarray:
    """Hashes of the prefixes that tell the sample's classes apart best, at most ``MINED``."""

    def count(batches):
        for batch in batches:
            label = batch.column(1).to_numpy()
            for first, end, data, off in text_slices(batch.column(0)):
                hashes, owners, rows = _word_parts(data, off)
                row_of = np.repeat(np.arange(end - first), np.diff(rows))
                for h, owner in zip(hashes, owners):
                    row = row_of[owner]
                    order = np.lexsort((h, row))
                    h, row = h[order], row[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    h, toxic = h[new], label[first + row[new]]
                    values, at = np.unique(h, return_inverse=True)
                    yield pa.record_batch([pa.array(signed(values)), pa.array(np.bincount(at, minlength=len(values))),
                                           pa.array(np.bincount(at, weights=toxic, minlength=len(values)).astype(np.int64))],
                                          names=["prefix", "n", "n1"])

    rows0, rows1 = totals
    counted = sample.mapInArrow(count, "prefix bigint, n bigint, n1 bigint").groupBy("prefix").agg(
        F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") >= MIN_ROWS)
    odds = F.log(((F.col("n1") + 0.5) / (rows1 + 1)) / ((F.col("n") - F.col("n1") + 0.5) / (rows0 + 1)))
    strength = F.col("odds") * F.sqrt("n1")
    best = (counted.withColumn("odds", odds).where((F.col("odds") > 1.5) & (strength > 4))
            .orderBy(strength.desc(), "prefix").limit(MINED).toPandas())
    return np.array(best.prefix, np.int64).view(np.uint64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample_rows: int = SAMPLE) -> Model:
    """Learn voters, label model and classifier from the labelled rows of the training folds."""
    sample = written(labelled_sample(docs, labels, id_col, text_col, label_col, sample_rows), "labelled")
    total, toxic = sample.agg(F.count("*"), F.sum("label")).first()
    lexicon = np.array([prefix_hash(w) for w in LEXICON], np.uint64)
    mined = mine_prefixes(sample, (total - (toxic or 0), toxic or 0)) if toxic else np.zeros(0, np.uint64)
    prefixes = np.unique(np.concatenate([lexicon, mined]))
    fixed = np.isin(prefixes, lexicon)

    def matrix(batches):
        for batch in batches:
            for first, end, data, off in text_slices(batch.column(0)):
                found, patterns = counts(prefixes, data, off)
                packed = np.hstack([found, patterns]).astype(np.float32)
                yield pa.record_batch([pa.array([row.tobytes() for row in packed], pa.binary()),
                                       batch.column(1).slice(first, end - first)], names=["row", "label"])

    held = sample.mapInArrow(matrix, "row binary, label int").toPandas()  # sample_rows x voters numbers at most
    if not total:
        found = np.vstack([np.eye(len(prefixes)), np.zeros((len(prefixes), len(prefixes)))])
        patterns = np.tile([0.0] * len(PATTERNS) + [50.0], (len(found), 1))
        q = np.repeat([0.9, 0.02], len(prefixes))
    else:
        whole = np.frombuffer(b"".join(held.row), np.float32).reshape(total, -1)
        found, patterns = whole[:, :len(prefixes)], whole[:, len(prefixes):]
        label = held.label.to_numpy().astype(np.float64)
        fired = np.hstack([votes(found, patterns), label[:, None]])
        start = np.stack([(fired[label == y].sum(axis=0) + 0.2) / ((label == y).sum() + 2) for y in (0, 1)])
        # insults fire on toxic texts, and labels are mostly right, before any row is seen
        start[:, :-1][1, :len(prefixes)][fixed] = np.maximum(start[1, :len(prefixes)][fixed], 0.1)
        start[:, -1] = 0.02, 0.9
        q = label_model(fired, start, float(label.mean()))
    return Model(prefixes, fixed, linear_classifier(inputs(found, patterns, fixed), q))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""

    def run(batches):
        for batch in batches:
            parts = [np.zeros(0)]
            for _, _, data, off in text_slices(batch.column(2)):
                parts.append(model.scores(data, off))
            value = np.concatenate(parts)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(value),
                                   pa.array((value >= PREDICT_AT).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"),
                        F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int"))
