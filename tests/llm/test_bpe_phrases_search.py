import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sqlscore.llm import bpe, collocations, lexical_search
from sqlscore.llm.queries import LLM_ORACLE, LLM_QUERIES

from conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def vocab():
    return bpe.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = ["", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "it's we'LL they're", "a  b\n\n\tc   ",
         "aaaa" * 500, "=-" * 3000, " " * 999, "日本語テキスト 🎉👩‍👩‍👧 é", "՘x࢏1꟒", "naïve Ünïcode\x00\x01\x7f\x85 z", "1234567 ½ ⅷ"]


def encoded(texts, vocab):
    ids, sizes = bpe.encode_texts(texts, vocab)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_bpe_equals_library(vocab, library):
    assert encoded(TEXTS, vocab) == [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from("aeth in's.\n")), min_size=1, max_size=4))
def test_bpe_equals_library_on_any_text(vocab, library, texts):
    got = encoded(texts, vocab)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    flat, sizes = np.array([i for x in got for i in x], dtype=np.int64), np.array([len(x) for x in got])
    assert bpe.decode_ids(flat, sizes, vocab) == [library.decode(x, skip_special_tokens=False) for x in got]


def test_words_of_assigned_code_points():
    points = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and not bpe.unassigned()[c]]
    words = bpe.regex.compile(bpe.WORDS)
    for at in range(0, len(points), 8192):
        text = "".join(f"\na{chr(c)}1{chr(c)}!{chr(c)}a" for c in points[at:at + 8192:3])
        assert words.findall(text) == bpe.library_words(text)


def test_portions_of_a_long_text(vocab, library, monkeypatch):
    monkeypatch.setattr(bpe, "PORTION", 40)
    text = "The quick brown fox don't   jump.\n\n" * 60
    assert encoded([text, "", text], vocab) == [library.encode(t, add_special_tokens=False).ids for t in (text, "", text)]


def test_decode_lossy(spark, library):
    rows = spark.createDataFrame([(1, [30325, 255], "x"), (2, None, "y"), (3, [], "z"), (4, [97, 50256, 999999, -1], None)],
                                 "k int, ids array<int>, text string")
    got = {r["k"]: r["text"] for r in bpe.bpe_decode(rows, PATH).collect()}
    assert got == {1: library.decode([30325, 255], skip_special_tokens=False), 2: "", 3: "",
                   4: library.decode([97, 50256], skip_special_tokens=False)}


def test_bpe_rows(spark, library):
    docs = spark.createDataFrame([(1, "a b", "q"), (1, "a b", "q"), (None, None, None), (2, "", "r")], "doc_id long, text string, ids string")
    got = bpe.bpe_encode(docs, PATH, decode=True).collect()
    ids = library.encode("a b").ids
    assert sorted(map(str, got)) == sorted(map(str, [
        got[0].__class__(doc_id=k, ids=i, decoded=t) for k, i, t in [(1, ids, "a b"), (1, ids, "a b"), (None, [], ""), (2, [], "")]]))
    assert bpe.bpe_encode(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# ---------------------------------------------------------------- phrases

def phrases_by_brute_force(rows, min_count, top=2000, max_words=5):
    count, total = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i:i + k])
                    count[key] = count.get(key, 0) + 1
    often = {k: n for k, n in count.items() if len(k[1]) > 1 and n >= min_count}
    out = {}
    for (lang, p), a in often.items():
        inside = any(n >= a for (other, q), n in often.items() if other == lang and len(q) > len(p)
                     and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if not inside:
            cuts = []
            for k in range(1, len(p)):
                left, right = count[lang, p[:k]], count[lang, p[k:]]
                cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
            for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


@pytest.fixture(autouse=True)
def few_ranges(monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_BITS", 2)


def phrases(spark, rows, **args):
    return {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, DOCS), **args).collect()}


def test_phrases_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["A", "b", "cé", "d'", " x", "new", "york"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n"]) for _ in range(rng.integers(0, 60))),
             [None, "en", "de"][i % 3]) for i in range(80)]
    rows += [(90, None, "en"), (91, "", "fr"), (92, "new york city " * 40, "en"), (92, "new york city " * 40, "en"), (None, "...", None)]
    for shard_words in (1 << 20, 150):
        assert phrases(spark, rows, min_count=6, shard_words=shard_words) == phrases_by_brute_force(rows, 6)
    assert phrases(spark, rows, min_count=6, top=3) == phrases_by_brute_force(rows, 6, top=3)


def test_phrases_of_one_word_and_hot_text(spark):
    rows = [(i, "a a a a a a, a a", "en") for i in range(30)]
    assert phrases(spark, rows, min_count=20, shard_words=40) == phrases_by_brute_force(rows, 20)


def test_phrases_empty(spark):
    assert phrases(spark, [], min_count=2) == set()
    assert phrases(spark, [(1, "one two", "en")], min_count=2) == set()


def test_long_text_in_portions(monkeypatch):
    monkeypatch.setattr(collocations, "PORTION", 10)
    text = b"ab cd ef gh ij kl.mn op.q." * 5
    assert b"".join(collocations.portions(text)) == text and len([*collocations.portions(text)]) > 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_index_counts(symbols):
    symbols = np.array([0, *symbols, 0])
    numbers = np.arange(1, 5) * 10
    numbers = numbers[:max(1, symbols.max())]
    lo, back, n, prefix, suffix = collocations.longer_phrases(symbols, numbers, None, 5)
    pairs = Counter((10 * a, 10 * b) for a, b in zip(symbols[:-1].tolist(), symbols[1:].tolist()) if a and b)
    assert Counter(dict(zip(zip(prefix.tolist(), suffix.tolist()), n.tolist()))) == pairs
    given = collocations.Intervals(lo, back, n, np.arange(len(lo)) + 100)
    _, _, n3, before, after = collocations.longer_phrases(symbols, numbers, given, 5)
    name = dict(zip(range(100, 100 + len(lo)), zip(prefix.tolist(), suffix.tolist())))
    triples = Counter((10 * a, 10 * b, 10 * c) for a, b, c in zip(symbols, symbols[1:], symbols[2:]) if a and b and c)
    assert Counter({(*name[p], name[s][1]): k for p, s, k in zip(before.tolist(), after.tolist(), n3.tolist())}) == triples


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 31), st.integers(2, 12), st.data())
def test_keys_of_phrases_are_one_to_one(half, range_bits, data):
    keys = collocations.Keys(half, range_bits)
    numbers = st.lists(st.integers(0, 2 ** half - 1), min_size=20, max_size=20)
    prefix, suffix = np.array(data.draw(numbers)), np.array(data.draw(numbers))
    key = keys.of(prefix, suffix)
    assert int(key.max()) < 1 << keys.bits
    assert [x.tolist() for x in keys.parts(key)] == [prefix.tolist(), suffix.tolist()]
    assert collocations.from_planes(collocations.to_planes(key, 8), 8).tolist() == key.tolist()


def test_no_table_has_a_row_per_shard_and_phrase(spark, monkeypatch):
    written = {}

    def counted(df, name, path=None, stash=collocations.stash):
        out = stash(df, name, path)
        written[name] = out.count()
        return out

    monkeypatch.setattr(collocations, "stash", counted)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz"], 2000)), "en") for i in range(40)]
    assert phrases(spark, rows, min_count=20, max_words=2, shard_words=2000) == phrases_by_brute_force(rows, 20, max_words=2)
    n_phrases, shards, ranges = 26 * 26, 40, 4
    assert all(n <= max(n_phrases, ranges * (shards + 1)) for n in written.values()), written


# ---------------------------------------------------------------- search

def search_by_brute_force(docs, items, top=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in found:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(map(str, out))


def searched(spark, docs, items, **args):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(str(tuple(r)) for r in lexical_search.lexical_search(d, i, **args).collect())


def test_search_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{int(k)}" for k in range(60)] + ["Été", "x-y", "ABC", " "]
    text = lambda n: " ".join(words[min(int(rng.exponential(9)), 63)] for _ in range(n))
    docs = [(i, text(int(rng.integers(1, 90)))) for i in range(160)] + [(500, text(4000)), (7, text(30)), (None, text(30)), (600, None), (601, "--")]
    docs += [(i, docs[3][1]) for i in range(700, 720)]
    items = [(i, text(12)) for i in range(12)] + [(3, text(5)), (None, text(9)), (50, None), (51, "nowhere"), (52, docs[3][1])]
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 200)
    for docs_a_block in (1024, 16):
        monkeypatch.setattr(lexical_search, "BLOCK_DOCS", docs_a_block)
        assert searched(spark, docs, items, top=5) == search_by_brute_force(docs, items, top=5)


def test_search_empty(spark):
    assert searched(spark, [], [(1, "a")]) == searched(spark, [(1, "a")], []) == searched(spark, [(1, None)], [(1, "a")]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=70), min_size=1, max_size=12), st.lists(st.integers(0, 12), min_size=1, max_size=9))
def test_bounds_are_never_below_scores(texts, item):
    counts = [Counter(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in counts])
    word = np.array([w for c in counts for w in c])
    count = np.array([n for c in counts for n in c.values()])
    names = [b"word%d" % i for i in range(13)]
    hashes = lexical_search.word_hashes(names)
    level = lexical_search.levels_of(count)
    assert all(2 ** j >= n and (j == 0 or 2 ** (j - 1) < n) for j, n in zip(level.tolist(), count.tolist()))
    bits = lexical_search.signature_of(doc, word, level, hashes, len(texts))
    m = 75 + np.array([len(t) for t in texts])
    weights = np.array([[item.count(w) * (w + 3) for w in range(13)]], dtype=np.float64)
    bound = lexical_search.upper_bounds(bits, int(level.max()) + 1, int(count.max()), m, hashes, weights)[0]
    added = lexical_search.gain(count, m[doc])
    score = np.bincount(doc, weights=weights[0, word] * added, minlength=len(texts))
    assert (bound >= score).all()


@pytest.mark.parametrize("name", ["op12_collocations", "op13_lexical_search"])
def test_queries_have_sql(name):
    assert name in LLM_ORACLE and name in LLM_QUERIES


def test_op11_query(spark, library):
    import hashlib
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = LLM_QUERIES["op11_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
