"""Declared schemas. Edits arrive as JSON text and are decoded once against EDIT_SCHEMA."""

from pyspark.sql import types as T

NODE = T.StructType([
    T.StructField("lon", T.StringType()),
    T.StructField("lat", T.StringType()),
])

METADATA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("comment", T.StringType()),
])

EDIT_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metadata", METADATA),
    T.StructField("nodes", T.ArrayType(NODE)),
])

# Raw edit rows: arrival sequence, arrival clock, JSON payload.
RAW_EDITS = T.StructType([
    T.StructField("edit_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("payload", T.StringType()),
])

POINT = T.StructType([
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])



def _columns(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


_TEXT, _LONG, _CLOCK = T.StringType(), T.LongType(), T.TimestampNTZType()

# Sink tables; ``batch_id``, ``version``, ``window_label``, ``channel`` and ``emit_id`` are folders (partition columns).
FEATURES = _columns(edit_id=_LONG, ts=_CLOCK, user=_TEXT, id=_TEXT, changeset=_TEXT, date=_TEXT, feature=_TEXT,
                    action=_TEXT, comment=_TEXT, hashtags=T.ArrayType(_TEXT), record=_TEXT, batch_id=_LONG)
HASHTAG_LOG = _columns(edit_id=_LONG, ts=_CLOCK, pos=T.IntegerType(), date=_TEXT, feature=_TEXT, hashtag=_TEXT,
                       batch_id=_LONG)
NEWEST = _columns(hashtag=_TEXT, ts=_CLOCK, edit_id=_LONG, pos=T.IntegerType(), date=_TEXT, feature=_TEXT,
                  min_ts=_CLOCK, batch_id=_LONG)
SCORES = _columns(window_label=_TEXT, hashtag=_TEXT, score=_LONG, as_of=_LONG, slot=T.IntegerType(), version=_LONG)
REJECTS = _columns(edit_id=_LONG, ts=_CLOCK, payload=_TEXT, reason=_TEXT, batch_id=_LONG)

# Bucket counts written by the streaming job (one row per hashtag, bucket and batch).
BUCKETS = T.StructType([
    T.StructField("hashtag", T.StringType()),
    T.StructField("bucket_end", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("batch_id", T.LongType()),
])

TIMELINE = T.StructType([
    T.StructField("position", T.LongType()),
    T.StructField("hashtag", T.StringType()),
    T.StructField("run", T.LongType()),
    T.StructField("feature", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("last", T.StringType()),
    T.StructField("count", T.LongType()),
])

CHANGES = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("record", T.StringType()),
])

FEED = T.StructType(TIMELINE.fields + [T.StructField("emit_id", T.LongType())])
