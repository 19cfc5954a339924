import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logframe.llm import prefix_trie
from logframe.llm.common import Scratch
from tests.llm.conftest import clashing

SCHEMA = "conv_id long, turn long, role string, text string"


def slow_trie(rows):
    """Nodes as tuples, from (conv_id, turn, role, text) rows, by plain dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        built[c] = turns if base == c else own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    worth = lambda p: (len(members[p]) - 1) * len(re.findall(rb"[^ \t-\r]+", p[-1][1])) if p else 0
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = worth(p) + sum(saved[k] for k in kids[p])
        ends = sorted(c for c in members[p] if len(built[c]) == len(p))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], digest))
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ODD = [
    (0, 0, "user", "a b"), (0, 1, "assistant", "c"), (0, 2, "user", "d e f"), (0, 3, "assistant", "g"), (1, 0, "user", "a b"), (1, 1, "assistant", "c"), (2, 0, "user", "a b"),
    (3, None, None, None), (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "assistant", "w\n z"), (45, 0, "user", "lone"), (47, 0, "user", "lone"), (47, 1, "user", "more"), (None, 0, "user", "nobody"),
    (-7, 0, "user", "a b"), (-7, 1, "assistant", "c"), (-25, 0, "user", "neg"), (60, 0, "user", "short base"), *[(c, t, "user", f"turn {t}") for c in range(61, 80) for t in range(c % 6)], (80, 0, "user", ""), (81, 0, "user", None),
    (9223372036854775807, 0, "user", "a b"), (5, 1, "user", "long " * 30_000), (6, 1, "user", "long " * 30_000),
]


def test_trie_of_odd_conversations(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert found(prefix_trie.shared_head_trie(df)) == slow_trie(ODD)
    assert found(prefix_trie.shared_head_trie(clashing(df))) == slow_trie(ODD)


@pytest.mark.parametrize(("block", "width"), [(2, 1 << 24), (3, 1 << 10), (65_536, 1 << 10)])
def test_trie_in_small_blocks_and_crowded_sketches(spark, block, width):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    assert found(prefix_trie.shared_head_trie(df, block, width)) == slow_trie(ODD)


def test_trie_of_a_table(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet")
    assert found(prefix_trie.shared_head_trie(rows)) == slow_trie([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


def test_no_conversations(spark):
    assert prefix_trie.shared_head_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.shared_head_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_one_conversation_in_many_tasks_and_a_deep_chain(spark):
    rows = [(20, t, "user", f"w {t % 7}") for t in range(3000)] + [(40, t, "user", f"w {t % 7}") for t in range(2500)] + [(60, t, "user", "w") for t in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    scratch = Scratch(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    turns = prefix_trie.number_turns(df, scratch)
    assert spark.read.parquet(f"{scratch.home}/turns").filter("conv_id = 20").select("part").distinct().count() > 1
    assert turns.groupBy("conv_id").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count_distinct("place").alias("n")).orderBy("conv_id").collect() == [(20, 0, 2999, 3000), (40, 0, 2499, 2500), (60, 0, 4, 5)]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found(prefix_trie.shared_head_trie(df, 100)) == slow_trie(rows)


def test_staircase_of_growing_conversations(spark):
    # each conversation goes on from the one before: every node has another owner
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(1, 40) for t in range(c)]
    assert found(prefix_trie.shared_head_trie(spark.createDataFrame(rows, SCHEMA))) == slow_trie(rows)


def test_the_screen_never_hides_a_shared_prefix(spark, data):
    scratch = Scratch(spark, "t")
    turns, convs = prefix_trie.share_heads(prefix_trie.number_turns(spark.read.parquet(f"{data}/conversations.parquet"), scratch), scratch)
    paths = scratch.keep(prefix_trie.prefixes(turns, convs, scratch), "p")
    for width in (1 << 10, 1 << 16):
        rows = prefix_trie.screened(paths, prefix_trie.crowded(paths, width), width)
        n = rows.groupBy("depth", "x", "y").agg(F.count("*").alias("n"), F.min("kind").alias("kind"))
        assert n.filter(f"n > 1 AND kind <> {prefix_trie.SHARED}").count() == 0
        assert n.filter(f"n = 1 AND kind <> {prefix_trie.SHARED}").count() > (0.9 if width > 1 << 10 else 0) * n.filter("n = 1").count()


@pytest.mark.parametrize("first", [0, -60])
def test_lone_prefixes_that_the_sketch_passes_for_shared_have_their_parents(spark, first):
    # two or three turns are shared, the others are not; 64 cells are few enough for chance hits below a lone prefix
    draw = np.random.default_rng(1)
    rows = [(c, t, "user", f"w {draw.integers(3 if t < 2 else 10**6)} x") for c in range(first, first + 120) for t in range(draw.integers(7))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.shared_head_trie(df, width=64)) == slow_trie(rows)
