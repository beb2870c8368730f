"""Language ID by Bayesian evidence fusion (operator 8).

The posterior of a language is the product of

* the *text likelihood*: a naive Bayes model over hashed letter trigrams, counted per declared
  language over all rows by a grouped aggregation (a fixed number of buckets, so the model's size is bounded);
* the *declared language* (markup attribute) and the *address suffix*: P(value | language), from grouped counts of
  the values against the text's own best language, smoothed towards the value's overall share;
* the *host prior*: shares of the text's best languages on the host, smoothed towards its
  parent domain's shares, these towards the overall ones.

A further hypothesis, ``other``, spreads its likelihood evenly over all buckets; text in no
known language, or in a script never seen, falls to it. A row is rejected when ``other`` wins, when it
holds no letter trigram (null, empty, digits), or when the best posterior is below ``min_posterior``.

Null declared values, suffixes and hosts are no evidence. Values outside ``languages`` are
evidence like any others but train no text model. Ties go to the earlier language of
``languages``. Equal rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .shingles import fold, text_slices

LANGUAGES = ("en", "fr", "de", "es")
BUCKET_BITS = 15
TEMPER = 1 / 3        # trigrams overlap: each letter counts about once
SMOOTH = 0.5          # added to each trigram bucket's count
ALPHA = 20.0          # rows' worth of the parent in a host's or value's shares
OTHER_PRIOR = 0.01
MIN_POSTERIOR = 0.5


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams (centre a letter, other bytes as spaces, A-Z and the Latin-1
    capitals folded) of each row, and the rows' offsets into them. Rows are padded by spaces."""
    padded = np.full(len(data) + 2 * (len(off) - 1), 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(len(off) - 1) + 1, np.diff(off))
    padded[at] = fold(data, digits=False)
    centre = padded[1:-1]
    code = (padded[:-2].astype(np.uint32) << 16) | (centre.astype(np.uint32) << 8) | padded[2:]
    keep = centre != 32
    rows = np.concatenate([[0], np.cumsum(keep)])
    begin = off + 2 * np.arange(len(off))  # each row's first centre
    bucket = (code[keep] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    return bucket.astype(np.int64), rows[np.minimum(begin, len(keep))]


def text_model(rows: DataFrame, text_col: str, declared_col: str, languages: Sequence[str]) -> np.ndarray:
    """Log-probabilities (language, bucket) from all rows with a declared language of ``languages``.
    Each task returns at most one row per bucket of a language, and the driver gets the sums."""
    place = {name: i for i, name in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(place), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            langs = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            for first, end, data, off in text_slices(batch.column(0)):
                bucket, at = trigrams(data, off)
                lang = np.repeat(langs[first:end], np.diff(at))
                known = lang >= 0
                total += np.bincount(lang[known] * (1 << BUCKET_BITS) + bucket[known], minlength=total.size
                                     ).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.record_batch([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()),
                               pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    counted = (rows.select(F.col(text_col).cast("string"), F.col(declared_col).cast("string"))
               .mapInArrow(count, "lang int, bucket int, n bigint")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    counts = np.full((len(place), 1 << BUCKET_BITS), SMOOTH)
    counts[counted.lang, counted.bucket] += counted.n
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_scores(rows: DataFrame, text_col: str, model: np.ndarray) -> DataFrame:
    """``rows`` without the text, with ``trigrams`` (their number) and ``loglik`` (one tempered
    log-likelihood per language, the last one for ``other``)."""
    plain = rows.drop(text_col)
    other = -BUCKET_BITS * math.log(2)
    width = len(model) + 1

    def score(batches):
        for batch in batches:
            logs, sizes = [], []
            for _, _, data, off in text_slices(batch.column(0)):
                bucket, at = trigrams(data, off)
                sums = np.zeros((len(off) - 1, width))
                for k, logp in enumerate(model):
                    run = np.concatenate([[0.0], np.cumsum(logp[bucket], dtype=np.float64)])
                    sums[:, k] = run[at[1:]] - run[at[:-1]]
                sums[:, -1] = np.diff(at) * other
                logs.append(sums * TEMPER)
                sizes.append(np.diff(at))
            logs = np.concatenate(logs) if logs else np.zeros((0, width))
            sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(logs) + 1) * width, pa.int32()), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes.astype(np.int64)), lists],
                                             names=[*batch.schema.names[1:], "trigrams", "loglik"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return rows.select(F.col(text_col).cast("string"), *[f"`{c}`" for c in plain.columns]).mapInArrow(
        score, f"{schema}, trigrams bigint, loglik array<double>")


def _counts(languages: Sequence[str]) -> list[Column]:
    return [F.sum(F.when((F.col("best") == i) & (F.col("trigrams") > 0), 1.0).otherwise(0.0)).alias(f"n{i}")
            for i in range(len(languages))]


def _shares(languages: Sequence[str], prior: Sequence) -> Column:
    """Shares of the languages among a group's counts n0.., smoothed towards ``prior``."""
    total = sum((F.col(f"n{i}") for i in range(1, len(languages))), F.col("n0"))
    return F.array(*[(F.col(f"n{i}") + ALPHA * prior[i]) / (total + ALPHA) for i in range(len(languages))])


def identify(rows: DataFrame, text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source",
             suffix_col: str | None = None, languages: Sequence[str] = LANGUAGES,
             min_posterior: float = MIN_POSTERIOR, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of ``rows``: the ``carry`` columns, ``language`` (null if rejected),
    ``posterior``, ``text_language`` (by the text alone), ``trigrams`` and ``kept``."""
    k = len(languages)
    nothing = F.lit(None).cast("string")
    given = rows.select(
        F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c_{c}") for c in carry],
        *[(F.col(c).cast("string") if c else nothing).alias(n) for c, n in
          ((declared_col, "_declared"), (host_col, "_host"), (suffix_col, "_suffix"))])
    known = F.slice("loglik", 1, k)
    with small_batches(rows.sparkSession):
        model = text_model(given, "_text", "_declared", languages)
        scored = written(text_scores(given, "_text", model)
                         .withColumn("best", F.array_position(known, F.array_max(known)) - 1)
                         .withColumn("_parent", F.regexp_extract("_host", r"([^.]+\.[^.]+)$", 1)), "language-scores")
    overall = scored.agg(*_counts(languages)).first()
    seen = sum(overall[i] or 0.0 for i in range(k))
    prior = [((overall[i] or 0.0) + 1.0) / (seen + k) for i in range(k)]

    # host prior: host -> parent domain -> all rows
    by_host = scored.where("_host is not null").groupBy("_host", "_parent").agg(*_counts(languages))
    by_host = written(by_host, "host-counts")
    parents = (by_host.groupBy("_parent").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)])
               .select("_parent", _shares(languages, [F.lit(p) for p in prior]).alias("_up")))
    hosts = written(by_host.join(parents, "_parent").select(
        "_host", _shares(languages, [F.col("_up")[i] for i in range(k)]).alias("_host_shares")), "host-shares")
    out = scored.join(hosts, "_host", "left")

    # P(value | language) for the declared language and the address suffix
    for col in ("_declared", "_suffix"):
        counts = scored.where(F.col(col).isNotNull()).groupBy(col).agg(*_counts(languages))
        total = sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0"))
        held = written(counts.select(col, F.array(*[
            (F.col(f"n{i}") + ALPHA * (total + 1) / (seen + k)) / (overall[i] + ALPHA if seen else ALPHA)
            for i in range(k)]).alias(f"{col}_p")), "evidence")
        out = out.join(held, col, "left")

    def log_posterior(i: int) -> Column:
        prior_i = F.coalesce(F.col("_host_shares")[i], F.lit(prior[i]))
        value = F.col("loglik")[i] + F.log(prior_i * (1 - OTHER_PRIOR))
        for col in ("_declared", "_suffix"):
            value = value + F.coalesce(F.log(F.col(f"{col}_p")[i]), F.lit(0.0))
        return value

    # under `other` a declared value or suffix says nothing: its overall share
    def other() -> Column:
        value = F.col("loglik")[k] + math.log(OTHER_PRIOR)
        for col in ("_declared", "_suffix"):
            mean = sum((F.col(f"{col}_p")[i] * prior[i] for i in range(1, k)), F.col(f"{col}_p")[0] * prior[0])
            value = value + F.coalesce(F.log(mean), F.lit(0.0))
        return value

    fused = out.withColumn("_lp", F.array(*[log_posterior(i) for i in range(k)], other()))
    top = F.array_max("_lp")
    fused = (fused.withColumn("_top", F.array_position("_lp", top))
             .withColumn("posterior", 1 / F.aggregate(F.transform("_lp", lambda x: F.exp(x - top)), F.lit(0.0),
                                                      lambda a, x: a + x)))
    kept = (F.col("trigrams") > 0) & (F.col("_top") <= k) & (F.col("posterior") >= min_posterior)
    names = F.array(*[F.lit(x) for x in languages])
    return fused.select(
        *[F.col(f"_c_{c}").alias(c) for c in carry],
        F.when(kept, F.element_at(names, F.col("_top").cast("int"))).alias("language"),
        F.col("posterior"),
        F.when(F.col("trigrams") > 0, F.element_at(names, F.col("best").cast("int") + 1)).alias("text_language"),
        "trigrams", kept.alias("kept"))


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Web pages as rows for ``identify``: (page_id, text, declared, host, suffix). ``declared`` is the markup's
    ``lang``, ``suffix`` a two-letter first folder of the path, else the host's last label."""
    page, url = F.col(html_col).cast("string"), F.col(url_col).cast("string")
    found = lambda col, pattern: F.nullif(F.lower(F.regexp_extract(col, pattern, 1)), F.lit(""))
    text = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    return pages.select(
        F.col(id_col).alias("page_id"), text.alias("text"),
        found(page, r"(?i)<html\b[^>]*?\blang=[\"']?([a-z]{2})").alias("declared"),
        found(url, r"^[a-z+]+://([^/?#:]*)").alias("host"),
        F.coalesce(found(url, r"(?i)^[a-z+]+://[^/?#]*/([a-z]{2})(?:[/?#]|$)"),
                   found(url, r"(?i)^[a-z+]+://[^/?#:]*\.([a-z]+)(?:[:/?#]|$)")).alias("suffix"))


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects. Rows are matched by a hash of all
    their values, so repeated ids are decided row by row; equal rows are decided alike."""
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in docs.columns])
    keyed = docs.withColumn("_row_key", key)
    rejected = identify(keyed, carry=["_row_key"], **options).where("not kept").select("_row_key").distinct()
    return keyed.join(rejected, "_row_key", "left_anti").select(*docs.columns)
