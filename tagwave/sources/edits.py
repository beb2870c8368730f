"""Edit sources (O-01) and the single JSON decode (O-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import utc_wall_clock
from ..schema import EDIT_SCHEMA, RAW_EDITS

CORRUPT = "_corrupt"
PARSE_SCHEMA = T.StructType(EDIT_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])


def read_edits(spark: SparkSession, fmt: str, path_or_options, streaming: bool = True,
               starting: str = "latest", max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Raw edits ``(edit_id, ts, payload)`` from files or a message bus.

    ``parquet``/``json``: files holding the RAW_EDITS columns. ``text``: one JSON edit per line; the
    arrival clock is the file's time. ``kafka``: topic options (needs the connector jar); the broker time is the arrival
    clock, starting at ``latest`` like the reference's stream position. Arrival clocks are UTC, so a clock change moves no
    window. Streams of these two have no ``edit_id``: the ingest hands out the sequence (``numbered_batch``). Read as a batch,
    a text line is numbered by its task and place, a message by partition and offset.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if streaming and max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if fmt in ("parquet", "json"):
        return reader.schema(RAW_EDITS).format(fmt).load(path_or_options)
    if fmt == "text":
        raw = reader.format("text").load(path_or_options)
        number = [] if streaming else [F.monotonically_increasing_id().alias("edit_id")]
        return raw.select(*number, utc_wall_clock(F.col("_metadata.file_modification_time")).alias("ts"),
                          F.col("value").alias("payload"))
    if fmt == "kafka":
        opts = dict(path_or_options)
        if streaming:
            opts.setdefault("startingOffsets", starting)
        raw = reader.format("kafka").options(**opts).load()
        number = [] if streaming else [kafka_sequence().alias("edit_id")]
        return raw.select(*number, utc_wall_clock(F.col("timestamp")).alias("ts"), F.col("value").cast("string").alias("payload"))
    raise ValueError(f"unsupported edit source format: {fmt}")


def numbered_batch(batch: DataFrame, first: int) -> tuple[DataFrame, int]:
    """A micro-batch with its arrival sequence ``edit_id`` and the next free number: batch after batch, and inside one by partition
    of the source and place in it, without gaps. ``batch`` should be persisted; one count per partition comes to the driver."""
    placed = batch.withColumn("_m", F.monotonically_increasing_id())
    at = F.shiftright("_m", 33).cast("int")
    counts = sorted(placed.groupBy(at.alias("p")).count().collect())
    offsets, total = [], first
    for p, n in counts:
        offsets.append((p, total))
        total += n
    starts = batch.sparkSession.createDataFrame(offsets, "_p int, _first bigint")
    out = (placed.withColumn("_p", at).join(F.broadcast(starts), "_p")  # a row per partition of the batch
           .withColumn("edit_id", F.col("_first") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))))
    return out.select("edit_id", *batch.columns), total


def kafka_sequence() -> Column:
    """Message sequence: an offset is unique only within its partition."""
    return F.shiftleft(F.col("partition").cast("bigint"), 44).bitwiseOR(F.col("offset"))


def parse_edits(df: DataFrame, col: str = "payload") -> DataFrame:
    """Decode the JSON payload once into struct ``e`` (PERMISSIVE; bad text keeps ``e._corrupt``).

    ``from_json`` sits under a one-element ``explode``: a Generate node is a barrier for
    predicate pushdown, so later filters on ``e`` reuse this decode instead of re-parsing the
    text inside a pushed-down filter. Edits without a sequence (an unnumbered stream) get a null ``edit_id``.
    """
    if "edit_id" not in df.columns:
        df = df.withColumn("edit_id", F.lit(None).cast("bigint"))
    decoded = F.from_json(F.col(col), PARSE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return df.select("*", F.explode(F.array(decoded)).alias("e"))
