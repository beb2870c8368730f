"""The conversation trie against a plain one, under many ways to cut the shards."""

import hashlib
import random
import zlib

import pytest

from tagwave.llm import prefix_trie as P


def plain_trie(rows):
    """Sorted node rows from (conv_id, turn, role, text); equal turns must be equal rows."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        head = conv - int(conv / 100) * 100
        path = tuple(own.get(conv - head, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
        ends.setdefault(path, []).append(conv)
    children = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    return sorted((min(c), len(n), min(members[n[:-1]]) if n else -1, len(c), children.get(n, 0), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, c in members.items())


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(names).collect())


def conversations(spark, rows):
    wide = [(*r, 1, "k") for r in rows]
    return spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, shard int, path string").repartition(4)


def random_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for conv in rnd.sample(range(-250, 1200), 350):
        for turn in range(rnd.choice([1, 2, 3, 4, 7])):
            rows.append((conv, turn if turn else rnd.choice([None, 0]), rnd.choice(["user", "assistant", None, ""]),
                         rnd.choice(["a", "bb", "é日", "", None, "long " * 50])))
    for conv in range(2000, 2160):  # copies of one conversation: heads of their groups and others
        rows += [(conv, k, "user", f"same {k}") for k in range(8)]
    rows += [(None, 0, "user", "no conversation"), (3001, 0, "user", "only turn"), (5, 9, "user", "twice"), (5, 9, "user", "twice")]
    rows += [(4400, k, "user", f"t{k % 3}") for k in range(700)] + [(4401, k, "user", f"t{k % 3}") for k in range(701)]
    return rows


@pytest.mark.parametrize("options", [{"least_shards": 1}, {}, {"least_shards": 60}, {"least_shards": 60, "skeleton_nodes": 30},
                                     {"least_shards": 400}])
def test_trie_equals_plain_trie(spark, options):
    rows = random_rows(len(options) + options.get("least_shards", 0))
    assert found(P.conversation_trie(conversations(spark, rows), **options)) == plain_trie(rows)


def test_shards_split_equal_conversations(spark):
    """A group of copies is cut between shards, its ids are hashed in order all the same."""
    rows = [(c, k, "user", f"t{k}") for c in range(0, 30_000, 100) for k in range(3)]
    paths = P.written(P.rebuilt_paths(conversations(spark, rows)), "test-paths")
    skeleton = P.make_skeleton(paths, least_shards=12)
    assert len(skeleton.splitters) > 4 and len(skeleton.parent) == 4
    assert found(P.trie_nodes(paths, least_shards=12)) == plain_trie(rows)


def test_long_paths_count_with_their_first_turns(spark, monkeypatch):
    monkeypatch.setattr(P, "SPLITTER_TURNS", 3)
    rows = random_rows(5)
    assert found(P.conversation_trie(conversations(spark, rows), least_shards=30)) == plain_trie(rows)


def test_turnless_and_empty(spark):
    some = [(c, 0, "user", "x") for c in (101, 202, 303)]  # absent heads; those with h > 0 lose their only turn
    assert found(P.conversation_trie(conversations(spark, some))) == plain_trie(some)
    assert found(P.conversation_trie(conversations(spark, some).limit(0))) == []
