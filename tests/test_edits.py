"""Rejects with every reason, the feature record, and the edit readers."""

import json
import os
import tempfile

from tagwave.operators import edits as E
from tagwave.sources.edits import parse_edits, read_edits


def _way(**over):
    base = {"type": "way", "id": "w1", "user": "u1", "action": "create", "tags": {"highway": "path"},
            "metadata": {"id": "c1", "created_at": "2024-01-01 00:00:00", "comment": "#a #b,"},
            "nodes": [{"lon": "1", "lat": "2"}, {"lon": "3", "lat": "4"}]}
    base.update(over)
    return json.dumps(base)


CASES = {
    1: ("{not json", "undecodable json"),
    2: (json.dumps({"id": "x"}), "no type"),
    3: (_way(tags=None), "no tags"),
    4: (_way(nodes=None), "no nodes"),
    5: (_way(nodes=[{"lon": "abc", "lat": "1"}, {"lon": "2", "lat": "3"}]), "bad coordinate"),
    6: (_way(nodes=[{"lon": "1", "lat": "2"}]), "too few points"),
    7: (_way(tags={"building": "no"}, nodes=[{"lon": "0", "lat": "0"}, {"lon": "1", "lat": "0"},
                                                {"lon": "0", "lat": "0"}]), "too few points"),
    8: (_way(user=None), "missing field"),
    9: (_way(), None),                                          # valid line
    10: (_way(tags={"landuse": "farm"}, nodes=None), None),     # filtered, not rejected
    11: (json.dumps({"type": "node", "id": "n1"}), None),       # not a way
}


def _edits(spark):
    rows = [(k, v[0]) for k, v in CASES.items()]
    return spark.createDataFrame(rows, "edit_id long, payload string").selectExpr(
        "edit_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "payload")


def test_rejects_every_reason(spark):
    got = {r.edit_id: r.reason for r in E.rejects(parse_edits(_edits(spark))).collect()}
    want = {k: v[1] for k, v in CASES.items() if v[1] is not None}
    assert got == want


def test_valid_feature_record(spark):
    feats = E.features(parse_edits(_edits(spark))).collect()
    assert [f.edit_id for f in feats] == [9]
    f = feats[0]
    assert (f.user, f.id, f.changeset, f.date, f.action) == ("u1", "w1", "c1", "2024-01-01 00:00:00", "create")
    assert f.feature == "LINESTRING (1.0000000000000000 2.0000000000000000, 3.0000000000000000 4.0000000000000000)"
    assert sorted(f.hashtags) == ["a", "b"] and f.comment == "#a #b,"


def test_absent_comment_defaults(spark):
    payload = _way(metadata={"id": "c", "created_at": "2024-01-01 00:00:00"})
    df = spark.createDataFrame([(1, payload)], "edit_id long, payload string").selectExpr(
        "edit_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "payload")
    f = E.features(parse_edits(df)).first()
    assert f.comment == "(no comment)" and f.hashtags == []


def test_read_edits_formats(spark):
    d = tempfile.mkdtemp(prefix="tagwave-read-")
    lines = [_way(), _way(id="w2")]
    with open(os.path.join(d, "edits.txt"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    text = read_edits(spark, "text", d, streaming=False)
    assert text.columns == ["edit_id", "ts", "payload"] and text.count() == 2
    assert E.features(parse_edits(text)).count() == 2
    jdir = tempfile.mkdtemp(prefix="tagwave-json-")
    _edits(spark).write.mode("overwrite").json(jdir)
    js = read_edits(spark, "json", jdir, streaming=False)
    assert js.count() == len(CASES) and dict(js.dtypes)["ts"] == "timestamp_ntz"
    stream = read_edits(spark, "json", jdir, streaming=True, max_files=1)
    assert stream.isStreaming
