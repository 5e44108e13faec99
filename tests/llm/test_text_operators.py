"""Language ID, toxicity, decontamination, WARC and line dedup on small fixtures."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from sqlscore.llm import langid, toxicity
from sqlscore.llm.decontaminate import decontaminate, with_simhash
from sqlscore.llm.line_dedup import host_of, html_lines, line_dedup
from sqlscore.llm.queries import LLM_QUERIES
from sqlscore.llm.warc import read_archive, record_bytes, write_archive

CLASH = ["row_id", "lang_pred", "score", "fp", "item", "h", "p", "sh", "region", "words", "key", "address", "copies", "host",
         "lines", "n", "draw", "nth", "labels"]


def clash(df):
    return df.withColumns({c: F.lit(3) for c in CLASH if c not in df.columns})


# ---------------------------------------------------------------- language ID

def test_language_id_held_out_accuracy(spark):
    out = LLM_QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", F.col("lang").alias("true_lang")), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 200 and 0 < len(held) < 100
    assert sum(r["lang_pred"] == r["true_lang"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_id_edges(spark):
    rows = [(i, "the cat and the hat " * 3, "en") for i in range(6)] + [(i, "le chat et la souris " * 3, "fr") for i in range(6, 12)]
    rows += [(20, None, "en"), (21, "", None), (22, "123 !?", "fr"), (23, "THE CAT " * 200_000, None), (24, "le chat", None),
             (24, "le chat", None), (None, "the hat", "en"), (25, "日本", None)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = langid.language_id(df, per_lang=4, landmarks=4).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    pred = {r["doc_id"]: r["lang_pred"] for r in out}
    assert [pred[i] for i in (20, 21, 22)] == ["und"] * 3 and (pred[23], pred[24], pred[None]) == ("en", "fr", "en")
    assert pred[25] in ("en", "fr")  # it has letters
    assert langid.language_id(df.limit(0)).count() == 0
    none = langid.language_id(df, may_learn=F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_folded_model_equals_the_kernel_form():
    """Scores of the folded matrix are those of Nystroem features and their ridge solution."""
    rng = np.random.default_rng(4)
    sample = sorted(((lang, np.sort(rng.choice(np.arange(base, base + 400), 60, replace=False)).astype(np.int32))
                     for lang, base in (("a", 0), ("b", 250)) for _ in range(20)), key=lambda x: (x[0], x[1].tobytes()))
    langs, grams, weights, offset = langid.fit(sample, 10, 1e-3)
    assert langs == ["a", "b"]
    kernel = lambda x, z: len(np.intersect1d(x, z)) / np.sqrt(len(x) * len(z))
    z = [g for _, g in sample[:5]] + [g for _, g in sample[20:25]]
    k = np.array([[kernel(g, m) for m in z] for _, g in sample])
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for a in z] for b in z]))
    phi = k @ (vector / np.sqrt(value))
    y = np.array([[lang == "a", lang == "b"] for lang, _ in sample], dtype=float)
    centred = phi - phi.mean(axis=0)
    dual = np.linalg.solve(centred.T @ centred / 40 + 1e-3 * np.eye(10), centred.T @ (y - 0.5) / 40)
    want = 0.5 + centred @ dual
    got = np.array([np.isin(grams, g).astype(float) @ weights / np.sqrt(len(g)) + offset for _, g in sample])
    assert np.allclose(got, want, atol=1e-3)


def test_long_texts_in_pieces(monkeypatch):
    text = "".join(random.Random(1).choice("abc é") for _ in range(3000))
    whole, parts = np.zeros(langid.GRAMS, bool), np.zeros(langid.GRAMS, bool)
    langid.mark_grams(text, whole)
    monkeypatch.setattr(langid, "PIECE_CHARS", 7)
    langid.mark_grams(text, parts)
    assert (whole == parts).all()
    spaced = text.replace("é", " ")
    want = toxicity.words_of(spaced)
    monkeypatch.setattr(toxicity, "PIECE_CHARS", 10)
    assert toxicity.words_of(spaced) == want == Counter(w.encode() for w in spaced.split())


# ---------------------------------------------------------------- toxicity

def chain_rows():
    rng = random.Random(8)
    words = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(20)]
    for i in range(400):
        text = " ".join(rng.choice(words) for _ in range(40))
        mild, severe = i % 3 == 0, i % 6 == 0
        yield i, text + " vileword" * mild + " awfulword" * severe, int(mild), int(severe)


def test_toxicity_chain(spark):
    rows = list(chain_rows())
    docs = clash(spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(900, None), (901, ""), (902, "Vileword!"), (None, "wabx"),
                                       (903, "wabx " * 300_000)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, m, s) for i, _, m, s in rows if i < 300] + [(900, 1, 1), (302, None, 1)],
                                   "doc_id long, mild int, severe int")
    chain = {"mild": F.col("mild"), "severe": F.col("severe")}
    out = {r["doc_id"]: r for r in toxicity.toxicity_chain(docs, labels, chain).collect()}
    assert len(out) == 405
    held = [r for r in rows if r[0] >= 300]
    assert sum(out[i]["is_mild"] == bool(m) for i, _, m, _ in held) >= 98
    assert sum(out[i]["is_severe"] == bool(s) for i, _, _, s in held) >= 98
    assert out[902]["is_mild"] and not out[900]["is_mild"] and out[901]["mild"] == 0.0 and not out[903]["is_mild"]
    assert toxicity.toxicity_chain(docs.limit(0), labels, chain).count() == 0
    bare = toxicity.toxicity_chain(docs, labels.limit(0), chain).agg(F.max("mild"), F.max(F.col("is_mild").cast("int"))).first()
    assert tuple(bare) == (0.0, 0)
    carried = toxicity.toxicity_chain(docs, labels, chain, carry=True).filter("row.doc_id = 5").first()
    assert carried["row"]["row_id"] == 3


def test_chain_feeds_out_of_fold_probabilities(monkeypatch):
    """The second model's last input is the first category's out-of-fold prediction."""
    seen = []
    plain = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda x, y, w, r: seen.append(x) or plain(x, y, w, r))
    x = [toxicity.sparse_row(t) for _, t, _, _ in chain_rows()]
    y = np.array([[m, s] for _, _, m, s in chain_rows()], dtype=bool)
    chain = toxicity.fit_chain(x, y, np.ones(len(x)), 50, 1e-4)
    assert len(seen) == 2 * (toxicity.FOLDS + 1) and len(chain) == 2
    first, second = seen[toxicity.FOLDS], seen[-1]
    assert second.shape[1] == first.shape[1] + 1 and 0 < second[:, -1].min() and second[:, -1].max() < 1
    assert chain[0][3] > 0.95 and chain[1][3] > 0.95


# ---------------------------------------------------------------- decontamination

def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def best_windows(docs, items, threshold=0.8):
    """Every window of every item's size, compared in full."""
    shingles = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    found = {}
    for d, text in docs:
        sh = shingles(words_of(text))
        for item, other in items:
            own = Counter(shingles(words_of(other)))
            m = sum(own.values())
            for start in range(len(sh)) if m else ():
                win = Counter(sh[start:start + m])
                common = sum((win & own).values())
                s = common / (m + sum(win.values()) - common)
                if s >= threshold and s > found.get((d, item), 0):
                    found[d, item] = s
    return {k: round(v, 9) for k, v in found.items()}


def benchmark_case():
    rng = random.Random(6)
    words = [a + b for a in "bcdfgh" for b in ("a", "eo", "iu", "on", "art")]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(5, 45)))) for i in range(12)]
    items += [(12, "too short here now"), (13, None), (14, items[0][1]), (15, "again and again " * 8), (16, " ".join(text(150)))]
    docs = []
    for i in range(60):
        w = text(rng.randint(0, 60))
        if i % 2:
            passage = words_of(rng.choice(items)[1])
            for _ in range(rng.randint(0, 3)):
                if passage:
                    passage[rng.randrange(len(passage))] = "changed"
            if i % 10 == 3:
                passage = passage[len(passage) // 2:] + passage[:len(passage) // 2]
            w += passage + text(rng.randint(0, 20))
        docs.append((i, ", ".join(w).upper() if i % 3 else " ".join(w)))
    docs += [(100, None), (101, ""), (102, items[1][1]), (102, items[1][1]), (None, items[2][1]), (103, "again and again " * 3000)]
    return docs, items


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination_finds_every_similar_window(spark, limit):
    docs, items = benchmark_case()
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    b = clash(spark.createDataFrame(items, "item_id long, text string"))
    out = decontaminate(d, b, broadcast_rows=limit).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in out} == best_windows(docs, items)
    assert len(out) == len({(r["doc_id"], r["item_id"]) for r in out}) > 10


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination_with_shared_and_null_item_ids(spark, limit):
    """Variants within the radius of each other but under 0.8, copied whole, and items without an identifier."""
    rng = random.Random(3)
    items = []
    for i in range(6):
        words = [f"w{rng.randrange(10_000)}" for _ in range(60)]
        items += [(i, " ".join(words)), (i, " ".join(words[:53] + ["x", "y", "z", "u", "v", "s", "t"])), (i, " ".join(words[7:] + ["o"] * 7))]
    items += [(None, " ".join(f"n{k}" for k in range(20))), (None, " ".join(f"m{k}" for k in range(30)))]
    docs = [(k, text) for k, (_, text) in enumerate(items)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for rows in (items, items[::-1]):
        out = decontaminate(d, spark.createDataFrame(rows, "item_id long, text string"), broadcast_rows=limit).collect()
        got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in out}
        assert got == best_windows(docs, items) == {(k, i): 1.0 for k, (i, _) in enumerate(items)} and len(out) == len(got)


def test_decontamination_of_passages_that_end_in_one_word(spark):
    """The first 179 of 200 words, then padding: 175 of 217 shingles are common."""
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(200))) for i in range(12)]
    docs = [(i, " ".join([*words_of(text)[:179], *["pad"] * (30 + i)])) for i, text in items]
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"),
                        spark.createDataFrame(items, "item_id long, text string")).collect()
    want = best_windows(docs, items)
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in out} == want and len(want) == 12


def test_simhash_tells_occurrences_apart(spark):
    """At a weighted similarity of 0.8 bits differ as much with repeats as without."""
    rng = random.Random(5)
    fresh = lambda n: [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
    rows = []
    for i in range(100):
        common, tail = fresh(176), fresh(1) * 20
        rows += [(2 * i, common + fresh(20)), (2 * i + 1, tail + common)]
    df = with_simhash(spark.createDataFrame(rows, "no long, win array<bigint>"), "win")
    fp = {r["no"]: r["fp"] & 0xFFFFFFFFFFFFFFFF for r in df.collect()}
    off = [(fp[2 * i] ^ fp[2 * i + 1]).bit_count() for i in range(100)]
    assert max(off) <= 23 and 8 < np.mean(off) < 11.5


def test_decontamination_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate(d, b).count() == 1
    assert decontaminate(d.limit(0), b).count() == 0 and decontaminate(d, b.limit(0)).count() == 0


def test_simhash_of_arrays(spark):
    rng = random.Random(3)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 300)]
    got = with_simhash(spark.createDataFrame([(x,) for x in rows], "win array<bigint>"), "win").collect()
    for r in got:
        n = len(r["win"])
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r["win"]) > n)
        assert r["fp"] & 0xFFFFFFFFFFFFFFFF == want


# ---------------------------------------------------------------- WARC

def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "x\r\ny", ""), (5, "u", "é" * 1000),
            (6, "u", "z" * 2_000_000), (2, "http://a/2", "same"), (None, "n", "same"), (None, "n", "alone"), (7, "", "s")]
    df = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    path = str(tmp_path / "archive")
    write_archive(df, path)
    payloads = [p or "" for _, _, p in rows]
    assert spark.read.parquet(path + "/payloads").count() == len(set(payloads))
    first = {p: min((i for i, _, q in rows if (q or "") == p and i is not None), default=None) for p in payloads}
    digest = lambda p: base64.b32encode(hashlib.sha1(p.encode()).digest()).decode()
    want = Counter((i, p or "", digest(p or ""), "response" if i == first[p or ""] else "revisit",
                    None if i == first[p or ""] else first[p or ""]) for i, _, p in rows)
    out = read_archive(spark, path)
    assert Counter((r["record_id"], bytes(r["payload"]).decode(), r["payload_digest"], r["record_type"], r["refers_to"])
                   for r in out.collect()) == want
    one = record_bytes(out).filter("record_id = 4").first()
    head, body = bytes(one["record"]).split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: revisit") and b"WARC-Target-URI: x%0D%0Ay" in head and body == b"\r\n\r\n"
    big = str(tmp_path / "small-are-responses")
    write_archive(df, big, min_bytes=3)
    kinds = {r["record_id"]: r["record_type"] for r in read_archive(spark, big).collect()}
    assert kinds[4] == kinds[3] == "response" and kinds[2] == "revisit"
    empty = str(tmp_path / "empty")
    write_archive(df.limit(0), empty)
    assert read_archive(spark, empty).count() == 0


def test_warc_hot_payload_and_damage(spark, tmp_path):
    df = spark.range(1500).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("hot").alias("html"))
    path = str(tmp_path / "hot")
    write_archive(df, path)
    out = read_archive(spark, path).agg(F.count("*"), F.countDistinct("record_id"), F.sum((F.col("record_type") == "response").cast("int")),
                                       F.max("refers_to")).first()
    assert tuple(out) == (1500, 1500, 1, 0)
    damaged = str(tmp_path / "damaged")
    spark.read.parquet(path + "/payloads").withColumn("payload", F.lit(b"hat")).write.parquet(damaged + "/payloads")
    spark.read.parquet(path + "/records").write.parquet(damaged + "/records")
    with pytest.raises(Exception, match="differs"):
        read_archive(spark, damaged).select("payload_digest").collect()


# ---------------------------------------------------------------- line dedup

def test_line_dedup(spark):
    rows = [(i, "http://Big.example:80/x", f"<p>menu</p><p>own {i}</p><br>menu<div> often{i % 2} </div>") for i in range(10)]
    rows += [(30, "http://two.example/a", "<p>both</p><p>first</p>"), (31, "http://two.example/b", "<p>both</p><p>second</p>")]
    rows += [(20, "http://u@one.example/", "<p>menu</p><p>alone</p>"), (21, None, "<p>menu</p>"), (22, "no host", "<p>menu</p>"),
             (23, "http://big.example/n", None), (24, "http://big.example/e", ""), (9, "http://big.example", "<p>menu</p>"),
             (25, "https://big.example?q", "<script>menu</script><!-- x --><p>rare</p>" + "<p>long</p>" * 50_000)]
    df = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    out = line_dedup(df, "page_id", host_of(F.col("url")), html_lines(F.col("html"))).collect()
    lines = lambda h: [x for x in (re.sub(r"\s+", " ", re.sub("<[^>]*>", "", y)).strip() for y in re.split(
        r"(?i)</?(?:p|br|div)\b[^>]*>", re.sub(r"(?is)<script.*?</script>|<!--.*?-->", " ", h or ""))) if x]
    host = lambda u: (m := re.match(r"https?://(?:[^/@]*@)?([^/?:]+)", u or "")) and m[1].lower()
    pages, seen = Counter(host(u) for _, u, _ in rows), defaultdict(int)
    for _, u, h in rows:
        for x in set(lines(h)):
            seen[host(u), x] += 1
    want = Counter()
    for i, u, h in rows:
        boiler = {x for x in lines(h) if host(u) and seen[host(u), x] >= 2 and seen[host(u), x] / pages[host(u)] > 0.3}
        kept = [x for x in lines(h) if x not in boiler]
        want[i, host(u), len(lines(h)), len(lines(h)) - len(kept), "\n".join(kept)] += 1
    assert Counter(map(tuple, out)) == want and any(k[3] for k in want)
    assert {r["text"] for r in out if r["host"] == "two.example"} == {"first", "second"}
    assert line_dedup(df.limit(0), "page_id", host_of(F.col("url")), html_lines(F.col("html"))).count() == 0
