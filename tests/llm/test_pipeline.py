"""The corpus pipeline stage by stage against brute force, and its guard."""

import subprocess
import sys
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as P
from conftest import SF
from sqlscore.llm.queries import LLM_ORACLE, LLM_QUERIES
from test_simhash_suffix import least_linked, naive_fingerprint
from test_text_operators import best_windows


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "shard"]
    clean = P.toxicity(spark, docs, SF)
    assert clean.columns == docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = set(ids(clean))
    clean_labelled = [i for i, t in labels.items() if not t]
    assert sum(i in left for i in clean_labelled) >= 0.95 * len(clean_labelled)

    one = P.near_dedup(spark, docs, SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [naive_fingerprint(t) for _, t in rows]
    label = least_linked(fps, lambda i: [j for j, v in enumerate(fps) if (v ^ fps[i]).bit_count() <= 3])
    groups = defaultdict(list)
    for (i, _), c in zip(rows, label, strict=True):
        groups[c].append(i)
    assert one.columns == docs.columns and ids(one) == sorted(map(min, groups.values()))

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, _ in best_windows(rows, bench)}
    rest = P.decontaminate(spark, docs, SF)
    assert rest.columns == docs.columns and ids(rest) == sorted(i for i, _ in rows if i not in dirty) and dirty

    mixed = P.mix(spark, docs, SF)
    assert mixed.columns == docs.columns and ids(mixed) == ids(docs)
    placed = P.shard(spark, docs, SF)
    assert ids(placed) == ids(docs) and {r["shard"] for r in placed.collect()} <= set(range(24))


def test_run_is_its_stages(spark):
    out = P.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert ids(out) == ids(docs) and set(docs.columns) == set(out.columns)


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, "one two three", "en", "a"), (None, "four five six", "en", "b"),
            (3, "x", "en", "a"), (3, "x", "en", "a"), (4, "word " * 100_000, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns(
        {c: F.lit(1) for c in ("n_chars", "row", "key", "slot", "place", "shard", "fp", "root", "is_toxic", "doc")})
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "shard":
            assert out.columns == docs.columns
        want = Counter({(r[0], r[1]) for r in rows}) if name == "near_dedup" else Counter((r[0], r[1]) for r in rows)
        if name == "near_dedup":
            want -= Counter([(2, "")])  # null and blank texts are one group
            got = Counter((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect())
        elif name == "shard":
            got = Counter((r[0], r[1]) for r in out.select(F.col("doc_id"), F.col("text")).collect())
        else:
            got = Counter((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect())
        assert got == want, name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_shards_are_runs_of_the_mix(spark):
    """Half of all rows come from src0; while no source has run out, every shard holds each
    source within the Pfair bound, and shards and slots follow the mixed order to the end."""
    parts, rest, rows_a_block = P.MIX_PARTS, P.MIX_REST_PARTS, P.MIX_BLOCK_ROWS
    names = [*parts, None]
    weight = {s: parts.get(s, rest) for s in names}
    total = sum(weight.values())
    counts = {s: w * rows_a_block * 4 for s, w in weight.items()}
    counts["src0"] += sum(counts.values()) - 2 * counts["src0"]
    source = [s for s in names for _ in range(counts[s])]
    docs = spark.createDataFrame([(i, f"text {i:06d} " * 20, "en", s) for i, s in enumerate(source)],
                                 "doc_id long, text string, lang string, source string").repartition(7)
    order = [r["doc_id"] for r in P.pfair_mix(docs, parts, rest_parts=rest, block_rows=rows_a_block)
             .orderBy("slot", "place").select("row.doc_id").collect()]
    for limit in (0, 100):  # one or several files a task
        spark.conf.set("spark.sql.files.maxRecordsPerFile", limit)
        try:
            mixed = P.stash(P.mix(spark, docs, SF), "test-mixed")
        finally:
            spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        placed = P.shard(spark, mixed, SF).select("doc_id", "source", "shard", "slot").collect()
        placed.sort(key=lambda r: (r["shard"], r["slot"]))
        assert [r["doc_id"] for r in placed] == order
        even = {r["shard"] for r in placed[:total * 4 * rows_a_block]} - {placed[total * 4 * rows_a_block]["shard"]}
        assert len(even) > 8
        for shard in even:
            got = Counter(r["source"] for r in placed if r["shard"] == shard)
            n = sum(got.values())
            for s in names:
                # under two blocks off in whole slots, and the shard's first and last block may be cut
                assert abs(got[s] - n * weight[s] / total) < 4 * rows_a_block, (shard, s)


def test_sharding_of_a_frame_that_is_not_written(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit(1).alias("_metadata"))
    placed = P.shard(spark, docs.coalesce(1), SF).orderBy("shard", "slot").collect()
    assert [r["doc_id"] for r in placed] == list(range(500)) and {r["_metadata"] for r in placed} == {1}


def test_registered_names():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in LLM_QUERIES) == 1
    assert "pipeline" in LLM_QUERIES and set(LLM_ORACLE) <= set(LLM_QUERIES)


def test_entry_without_the_llm_folder():
    code = ("import sys; sys.modules['sqlscore.llm'] = None\n"
            "import __spark_entry__ as e\n"
            "assert 'result_equiv' in e.queries() and not any(q.startswith('op') for q in e.queries())")
    root = P.__file__.rsplit("/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
