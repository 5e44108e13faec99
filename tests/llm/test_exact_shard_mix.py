"""Exact dedup, sharding and mixing against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sqlscore.llm.exact_dedup import exact_dedup
from sqlscore.llm.mixing import period, pfair_mix, phases
from sqlscore.llm.sharding import shard_by_bytes

LONG = "word " * 40_000
EDGES = [(1, None), (2, ""), (3, "a  b"), (4, "a\tb"), (5, "a b"), (5, "a b"), (None, "a b"), (None, "lone"), (6, LONG),
         (7, LONG.strip() + "\n\n"), (8, " a b"), (9, "a b"), (10, "é"), (11, "b a")]
CLASH = ["keep_id", "digest", "n", "row_id", "size", "key", "range", "shard", "row", "slot", "u", "mix_source", "chunk"]


def table(spark, rows):
    """Rows of (doc_id, text) with columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASH})


def test_exact_dedup_edges(spark):
    groups = defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t in EDGES:
        groups[norm(t)].append(i)
    keep = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    want = Counter((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest())
                   for i, t in EDGES)
    for radix in (1, 3):
        got = exact_dedup(table(spark, EDGES).repartition(5), radix_bits=radix)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert Counter(map(tuple, got.collect())) == want
    assert exact_dedup(table(spark, [])).count() == 0


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "x y")] * 5 + [(2, "x  y")] + [(None, "lone")] * 3
    got = exact_dedup(table(spark, rows).repartition(4)).collect()
    assert Counter((r["doc_id"], r["kept"]) for r in got) == {(1, True): 1, (1, False): 4, (2, False): 1, (None, True): 1, (None, False): 2}


def test_exact_dedup_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(
        F.col("id").cast("string")).alias("text")).repartition(16)
    got = exact_dedup(df).filter("text_sha256 = sha2('same', 256)").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"),
                                                                       F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (1000, 0, 0, 1)


@pytest.mark.parametrize("rows", [EDGES, [(i, f"text {i % 7} " * (i % 50)) for i in range(2000)],
                                  [(i, "copy") for i in range(500)] + [(i, f"t{i}") for i in range(500, 600)]])
def test_shards_are_whole_gapless_and_even(spark, rows):
    out = shard_by_bytes(table(spark, rows).repartition(4), n_shards=6).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in out:
        assert (r["law"], r["grown_shard"]) == ("bytes", None) and 0 <= r["shard"] < 6
        by[r["shard"]].append(r)
    for members in by.values():
        assert sorted(m["slot"] for m in members) == list(range(len(members)))
    mean, groups, homes = sum(r["size"] for r in out) / 6, defaultdict(int), defaultdict(set)
    text_of = {i: t for i, t in rows if i is not None}
    for r in out:
        if r["doc_id"] in text_of:
            groups[r["text_crc32"], r["size"]] += r["size"]
            homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(homes[g]) == 1 for g in groups if groups[g] <= mean * 0.9)  # whole unless larger than a shard
    largest = max([r["size"] for r in out] + [n for n in groups.values() if n <= mean])
    assert all(abs(sum(m["size"] for m in by[s]) - mean) <= largest for s in range(6))


@pytest.mark.parametrize("copies", [40, 150, 700])
def test_groups_of_copies_stay_whole(spark, copies):
    rows = [(i, f"text number {i}") for i in range(1000)] + [(5000 + i, "many copies of this") for i in range(copies)]
    rows += [(9000 + i, f"pair {i // 2}") for i in range(200)]
    for ranges in (None, 64):
        out = shard_by_bytes(table(spark, rows).repartition(5), n_shards=8, ranges=ranges).collect()
        text, homes, sizes = dict(rows), defaultdict(set), defaultdict(int)
        for r in out:
            homes[text[r["doc_id"]]].add(r["shard"])
            sizes[text[r["doc_id"]]] += r["size"]
        mean = sum(sizes.values()) / 8
        assert len(out) == len(rows) and all(len(homes[t]) == 1 for t in homes if sizes[t] <= mean)
        assert (len(homes["many copies of this"]) > 1) == (sizes["many copies of this"] > mean)
        for s in range(8):
            assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def schedule_by_brute_force(sizes, parts, block_rows):
    """Earliest deadline first, slot by slot; when a source has no block left the others start anew."""
    left = {s: -(-n // block_rows) for s, n in sizes.items() if n}
    done, out, slot = dict.fromkeys(left, 0), {}, 0
    while left:
        total, k, t = sum(parts[s] for s in left), dict.fromkeys(left, 0), 0
        ended = False
        while not ended:
            ready = [(-(-(k[s] + 1) * total // parts[s]), s) for s in left if k[s] * total // parts[s] <= t]
            _, s = min(ready)
            out[s, done[s]] = slot
            done[s], k[s], left[s], t, slot = done[s] + 1, k[s] + 1, left[s] - 1, t + 1, slot + 1
            ended = not left[s]
        left = {s: n for s, n in left.items() if n}
    return out


def test_mixing_against_a_plain_scheduler(spark):
    rows = [(i, "a" if i < 100 else "b" if i < 500 else "c") for i in range(1100)] + [(None, "b")] * 9
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("x", F.xxhash64(F.rand(3)))
    parts = {"a": 3, "b": 2, "c": 2}
    out = pfair_mix(df.repartition(5), parts, rest_parts=1, block_rows=8).select("row.source", "block", "slot", "place").collect()
    sizes = Counter(s for _, s in rows)
    want = schedule_by_brute_force({i: sizes[s] for i, s in enumerate("abc")}, {0: 3, 1: 2, 2: 2}, 8)
    got = {("abc".index(r["source"]), r["block"]): r["slot"] for r in out}
    assert got == want and len(want) == sum(-(-n // 8) for n in sizes.values())
    assert Counter((r["source"], r["block"] * 8 + r["place"]) for r in out) == Counter((s, i) for s, n in sizes.items() for i in range(n))


def test_mixing_order_of_shared_identifiers_is_fixed(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.col("id").alias("x"))
    orders = [[r["x"] for r in pfair_mix(df.repartition(n), {"a": 1}).select("row.x", "slot", "place").orderBy("slot", "place").collect()]
              for n in (2, 7)]
    assert orders[0] == orders[1] and sorted(orders[0]) == list(range(3000))


def test_sharding_empty_carry_and_overfull(spark):
    assert shard_by_bytes(table(spark, []), n_shards=6).count() == 0
    rows = [(i, f"t{i}") for i in range(50)]
    carried = shard_by_bytes(table(spark, rows), n_shards=3, carry=True, ranges=2)
    assert sorted((r["row"]["doc_id"], r["row"]["text"], r["row"]["shard"]) for r in carried.collect()) == sorted(
        (i, t, 7) for i, t in rows)


def test_period_keeps_every_lag_below_one():
    for parts in ({0: 1, 1: 1}, {0: 12, 1: 8, 2: 8, 3: 4, 4: 4}, {0: 1, 1: 7, 2: 3}, {0: 97, 1: 2, 2: 1}):
        total, slots = sum(parts.values()), period(parts)
        assert sorted(x for v in slots.values() for x in v) == list(range(total))
        for s, w in parts.items():
            for t in range(total + 1):
                assert abs(sum(x < t for x in slots[s]) - t * w / total) < 1


def test_phases_use_every_block_once():
    plan, layout = phases({0: 3, 1: 2, 2: 5}, {0: 17, 1: 4, 2: 0})
    at = {(p, s, j): x for p, s, j, x in layout}
    seen = sorted(start + (k - first) // a * total + at[phase, s, (k - first) % a]
                  for s, phase, first, end, a, total, start in plan for k in range(first, end))
    assert seen == list(range(21))


def test_mixing_keeps_rows_and_weights(spark):
    rows = [(i, "a" if i % 10 < 6 else "b" if i % 10 < 9 else None) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumns({c: F.lit(7) for c in CLASH})
    out = pfair_mix(df, {"a": 1, "b": 2}, rest_parts=1, block_rows=4).select("row.doc_id", "row.source", "block", "slot", "place").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(1200))
    blocks = {(r["slot"], r["source"]) for r in out}
    assert len(blocks) == len({s for s, _ in blocks})  # a slot has one block
    weight = {"a": 1 / 4, "b": 2 / 4, None: 1 / 4}
    first_end = min(max(s for s, x in blocks if x == name) for name in weight) + 1
    for name, w in weight.items():
        mine = sorted(s for s, x in blocks if x == name)
        for t in range(first_end + 1):
            assert abs(sum(s < t for s in mine) - t * w) < 1
    assert pfair_mix(df.limit(0), {"a": 1}).count() == 0
