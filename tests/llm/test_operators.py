"""Each operator against its plain definition on awkward rows, and on empty tables."""

import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases
from areacast.llm import jaccard, langid, lm, mixing, packing, quality, sharding, substring
from areacast.llm import queries, tokencount, topk
from areacast.llm.fmindex import SegmentIndex
from areacast.llm.text import tidy, word_hashes
from tokenizers import Tokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    cases.frame(spark).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return cases.frame(spark, [])


PAIRS = [r[:2] for r in cases.rows()]


def got(df, *columns):
    return cases.ordered(tuple(r) for r in df.select(*columns).collect())


def test_jaccard_equals_all_pairs(docs, empty):
    out = jaccard.jaccard_components(docs)
    assert got(out, "doc_id", "n_shingles", "component_id") == cases.ordered(cases.jaccard(PAIRS))
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_of_many_near_copies(spark):
    base = [f"w{i}" for i in range(80)]
    data = []
    for i in range(150):
        w = list(base)
        w[(7 * i) % 80] = f"x{i}"
        w[(31 * i + 5) % 80] = f"y{i % 7}"
        data.append((i, " ".join(w[: 80 - i % 20])))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    out = jaccard.jaccard_components(df)
    assert got(out, "doc_id", "n_shingles", "component_id") == cases.ordered(cases.jaccard(data))


@pytest.mark.parametrize("part_bits, large", [(11, 64), (1, 2), (2, 64)])
def test_jaccard_of_lists_in_one_part_and_in_several(spark, monkeypatch, part_bits, large):
    monkeypatch.setattr(jaccard, "PART_BITS", part_bits)
    monkeypatch.setattr(jaccard, "LARGE", large)
    rng, data = random.Random(9), []
    shared = [f"s{i}" for i in range(24)]
    for group in range(12):
        own = shared + [f"g{group}-{i}" for i in range(10 + group)]
        for _ in range(7):
            w = list(own)
            for at in rng.sample(range(len(w)), rng.randrange(3)):
                w[at] = f"x{rng.randrange(9)}"
            data.append((len(data), " ".join(w[: len(w) - rng.randrange(6)])))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    out = jaccard.jaccard_components(df)
    assert got(out, "doc_id", "n_shingles", "component_id") == cases.ordered(cases.jaccard(data))


def test_texts_of_verified_pairs_are_picked_in_the_scan(spark):
    docs = spark.range(20_000).selectExpr("id", "concat('t', id) text", "1 other")
    asked = spark.range(0, 20_000, 97).selectExpr("id - 3 id", "id node")
    ids = {r["id"] for r in jaccard._picked(docs, asked).collect()}
    wanted = {r["id"] for r in asked.where("id >= 0").collect()}
    assert wanted <= ids and len(ids) <= len(wanted) + 20
    assert jaccard._picked(docs, asked.where("id > 90000")).count() == 0


def test_linked_sets_share_enough_rare_shingles():
    rng, linked = random.Random(5), 0
    for _ in range(4000):
        n = rng.randint(1, 90)
        a = set(rng.sample(range(120), n))
        b = set(a)
        for x in rng.sample(sorted(a), rng.randint(0, n // 5)):
            b.discard(x)
        b |= set(rng.sample(range(120, 240), rng.randint(0, n // 6 + 1)))
        if not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        linked += 1
        order = dict(zip(rng.sample(range(240), 240), range(240), strict=True))
        rare = [set(sorted(s, key=order.get)[: jaccard.rare_count(len(s), 75)]) for s in (a, b)]
        assert jaccard.fits(len(a), len(b), 75)
        assert len(rare[0] & rare[1]) >= jaccard.shared(len(a), len(b), 75) >= 1
    assert linked > 1000


def test_sets_of_any_size_share_the_least_that_is_asked():
    for percent in (60, 75, 90):
        for n in range(1, 400):
            most = n * 100 // percent
            for m in range(n, most + 1):
                asked = jaccard.shared(n, m, percent)
                assert asked >= jaccard.least_shared(m) >= jaccard.least_shared(n)


def test_sql_of_the_search_equals_its_functions(spark):
    pairs = [(n, m) for n in range(1, 300, 7) for m in range(1, 400, 11)]
    table = spark.createDataFrame(pairs, "n long, m long").selectExpr(
        "n", "m", f"{jaccard.COMMON.format(n='n', percent=75)} common",
        f"named_struct('n', m, 'common', {jaccard.COMMON.format(n='m', percent=75)}) x",
        f"{jaccard.LEAST_SHARED} least",
    ).selectExpr("n", "m", "least", f"{jaccard.SHARED.format(percent=75)} shared")
    for n, m, least, shared in table.collect():
        assert (least, shared) == (jaccard.least_shared(n), jaccard.shared(n, m, 75))


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(5)
    for _ in range(200):
        lists = [sorted(set(rng.integers(0, 60, rng.integers(0, 40)).tolist())) for _ in range(rng.integers(1, 9))]
        least = int(rng.integers(1, 6))
        count = Counter(x for one in lists for x in one)
        assert jaccard.divide_skip(lists, least) == sorted(x for x, c in count.items() if c >= least)


def test_languages(docs, empty):
    model = langid.fit_languages(docs)
    assert model.languages == ("de", "en")
    out = langid.predict_languages(docs, model)
    assert out.columns[:5] == docs.columns[:5] and out.count() == len(PAIRS)
    for r in out.collect():
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert 0 <= r["lang_score"] <= 1 and (r["lang_pred"] == "und") == (not letters)
        if r["doc_id"] and r["doc_id"] >= 100:
            assert r["lang_pred"] == r["lang"]
    assert langid.fit_languages(empty) is None
    assert langid.predict_languages(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict_languages(docs, None).collect()} == {"und"}


def test_language_scores_are_kernel_products():
    held = {"a": [langid.gram_slots("aaab abab")], "b": [langid.gram_slots("xyzz yxzx")]}
    model = langid._ridge(("a", "b"), held, 2, 1e-3)
    z = [held["a"][0], held["b"][0]]

    def kernel(x, y):
        return len(np.intersect1d(x, y)) / math.sqrt(len(x) * len(y))

    k = np.array([[kernel(x, y) for y in z] for x in z])
    w = np.linalg.solve(k @ k + 1e-3 * 2 * k, k @ np.array([[1, -1], [-1, 1]]))
    x = langid.gram_slots("abxz zz")
    assert np.allclose(model.scores(["abxz zz"])[0], [kernel(x, y) for y in z] @ w, atol=1e-4)


def test_token_counts_equal_the_library(docs, empty):
    library = Tokenizer.from_file(WORDS)
    expected = []
    for id, text in PAIRS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((id, len((text or "").encode()), n, n > 2048))
    out = tokencount.token_counts(docs, WORDS)
    assert got(out, "doc_id", "n_bytes", "n_tokens", "over_limit") == cases.ordered(expected)
    assert tokencount.token_counts(empty, WORDS).count() == 0


def test_every_prefix_is_exact():
    library, counter = Tokenizer.from_file(WORDS), tokencount.counter(WORDS)
    for word in ("unbelievably", "thnderheation", "ñciónmente", "1", "!!!###", "grüßen"):
        exact = counter.word_prefixes(word)
        data = word.encode()
        for i in range(1, len(data) + 1):
            try:
                part = data[:i].decode()
            except UnicodeDecodeError:
                continue
            assert exact[i] == len(library.encode(part, add_special_tokens=False).ids), part
    text = "It's a thnderheation of <|endoftext|> words"
    for budget in range(12):
        n, more = counter.fitting(text, budget)
        assert counter.prefixes(text)[n] <= budget
        assert n == len(counter.prefixes(text)) - 1 or counter.prefixes(text)[n + 1] > budget


def test_quality_counts(docs, empty):
    out = quality.quality_rules(docs)
    expected = []
    for id, text in PAIRS:
        w, t = cases.words(text), text or ""
        lines = [x for x in t.split("\n") if cases.words(x)]
        n_repeat = cases.repeated_words(text)
        expected.append(
            (id, len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t),
             len(lines) - len(set(lines)), n_repeat, len(w) < 20 or 100 * n_repeat > 30 * len(w))
        )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(out, "doc_id", *names) == cases.ordered(expected)
    assert out.where("kept and (base_failed or size(broken) > 0)").count() == 0
    assert out.where("not kept and not base_failed and size(broken) = 0").count() == 0
    assert quality.quality_rules(empty).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_substrings_equal_the_definition(docs, empty):
    out = substring.remove_repeats(docs)
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(out, *names) == cases.ordered(cases.without_repeats(PAIRS))
    assert substring.remove_repeats(empty).count() == 0


def test_equal_words_alone_have_equal_hashes():
    rng = random.Random(3)
    letters = [bytes([c]) for c in range(256) if bytes([c]).split()]
    pool = [b"".join(rng.choices(letters, k=rng.choice([1, 2, 3, 63, 64, 65, 66, 300]))) for _ in range(3000)]
    pool = [w for w in pool if len(w.split()) == 1] + [b"a" * n for n in range(1, 200)] + [b"x" * 5_000_000]
    parts = [rng.choice(pool) for _ in range(70_000)] + pool
    rng.shuffle(parts)
    parts = [w for i, w in enumerate(parts) if len(w) < 1000 or i % 40_000 == 0] + [pool[-1]] * 2
    seen: dict[bytes, set] = {}
    for w, h in zip(parts, word_hashes(parts).tolist(), strict=True):
        seen.setdefault(w, set()).add(h)
    assert all(len(h) == 1 for h in seen.values())
    assert len({h for each in seen.values() for h in each}) == len(seen)
    assert all(word_hashes([w])[0] in h for w, h in seen.items())
    assert len(word_hashes([])) == 0


def test_keys_of_texts_together_equal_those_of_each():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = rng.integers(0, 40, rng.integers(1, 12))
        texts = [rng.integers(0, 6, n).astype(np.uint64) for n in sizes]
        start = np.cumsum(sizes) - sizes
        together = zip(*(x.tolist() for x in substring.minimizer_runs(np.concatenate(texts), 13, sizes)))
        each = [
            (key, a + int(start[i]), z + int(start[i]))
            for i, t in enumerate(texts)
            for key, a, z in zip(*(x.tolist() for x in substring.minimizer_runs(t, 13)))
        ]
        assert list(together) == each
        for t in texts:
            grams = substring.window_hashes(t, substring.GRAM)
            windows = [
                (int(key), i)
                for key, a, z in zip(*substring.minimizer_runs(t, 13))
                for i in range(a, z + 1)
            ]
            assert windows == [(int(min(grams[i : i + 7])), i) for i in range(max(0, len(t) - 12))]


@pytest.mark.parametrize("words", [3, 4000])
def test_index_finds_how_far_windows_stand_elsewhere(words):
    rng = np.random.default_rng(words)
    segments = [rng.integers(1, words, rng.integers(13, 70)).astype(np.uint64) for _ in range(40)]
    segments += [np.append(rng.integers(1, words, 3).astype(np.uint64), s[: rng.integers(10, 14)]) for s in segments]
    index = SegmentIndex(segments, 13)
    values = rng.permutation(len(segments))
    held = {}
    for s, part in enumerate(segments):
        for n in range(1, 14):
            for i in range(len(part) - n + 1):
                held.setdefault(tuple(part[i : i + n].tolist()), []).append(values[s])
    for s, part in enumerate(segments):
        at = np.arange(len(part) - 12)
        if not len(at):
            continue
        length, low, high = index.matches(index.starts[s] + at, 13)
        for i in at.tolist():
            window = part[i : i + 13].tolist()
            most = max((n for n in range(1, 14) if len(held[tuple(window[13 - n :])]) > 1), default=0)
            assert length[i] == most
        full = np.flatnonzero(length == 13)
        if len(full):
            first = index.smallest(low[full], high[full], values)
            assert first.tolist() == [min(held[tuple(part[i : i + 13].tolist())]) for i in full.tolist()]


def test_substrings_with_hot_keys(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(40))
    data = [(i, f"a{i} b{i} c{i % 3} {passage} d{i} e{i % 2}") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(substring, "HOT", 4)
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(substring.remove_repeats(df), *names) == cases.ordered(cases.without_repeats(data))


def test_a_task_indexes_some_cells_at_a_time(monkeypatch):
    rng = np.random.default_rng(8)
    part = [rng.integers(0, 256, 20 * substring.SYMBOL, np.uint8).tobytes() for _ in range(900)]
    data = [(i // 10, i, part[i if i % 7 else i // 10 * 10], 20, [f"r{i}"], [5]) for i in range(900)]
    known = [(3, 5000, None, 20, ["k"], [7])]
    sizes = []

    class Index(SegmentIndex):
        def __init__(self, segments, depth):
            sizes.append(len(segments))
            super().__init__(segments, depth)

    def answers(step):
        table = substring._columns(data[:35] + known + data[35:], substring._SEGMENTS)
        batches = iter([table.slice(at, step) for at in range(0, table.num_rows, step)])
        out = [r for b in substring._matched(13)(batches) for r in b.to_pylist()]
        return sorted(tuple(r.values()) for r in out)

    monkeypatch.setattr(substring, "SegmentIndex", Index)
    expected = sorted(
        [(i, f"r{i}", 5, 25) for c, i, p, *_ in data if any(p == q and c == d and j < i for d, j, q, *_ in data)]
        + [(5000, "k", 7, 27)]
    )
    assert len(expected) > 20
    for most in (1, 25, 100, 10_000):
        monkeypatch.setattr(substring, "_INDEXED", most)
        for step in (1, 7, 10, 1000):
            sizes.clear()
            assert answers(step) == expected
            assert sum(sizes) == len(data) and max(sizes) < most + 10


def test_a_tidy_task_gives_freed_memory_back():
    def held():
        lines = Path("/proc/self/status").read_text().splitlines()
        return next(int(x.split()[1]) for x in lines if x.startswith("RssAnon"))

    kept, peak = [], []

    def run(batches):
        for batch in batches:
            freed = [b"%06d" % i * 300 for i in range(150_000)]
            kept.append(b"%06d" % len(freed) * 300)
            peak.append(held())
            del freed
            yield batch

    batch = pa.record_batch({"a": pa.array([1, 2])})
    assert list(tidy(run)(iter([batch]))) == [batch]
    assert held() < peak[0] - 200_000


def test_a_key_of_many_documents_of_each_task_is_hot():
    passage = " ".join(f"p{i}" for i in range(13))

    def keys(texts):
        return list(substring._keys(13)(iter([pa.record_batch({"text": pa.array(texts)})])))

    sent = [
        b
        for part in range(4)
        for b in keys([f"{passage} {part} {i}" for i in range(1500)] + [f"{' '.join(f'q{part}{j}' for j in range(20))}"])
    ]
    rows = sorted((r for b in sent for r in b.to_pylist()), key=lambda r: (r["known"], r["key"], r["doc"]))
    table = pa.Table.from_pylist(rows, sent[0].schema)
    for size in (3, 10_000):
        out = [r for b in substring._shared(iter(table.to_batches(size))) for r in b.to_pylist()]
        hot = {r["key"]: r["rows"] for r in out if r["doc"] is None}
        docs = Counter(r["key"] for r in {(r["key"], r["doc"]): r for r in out if r["doc"] is not None}.values())
        assert hot and hot == {k: n for k, n in docs.items() if n >= substring.HOT} and set(hot.values()) == {6000}


def test_mixing(docs, empty):
    out = mixing.mix_sources(docs).cache()
    assert out.count() == len(PAIRS) and set(docs.columns) <= set(out.columns)
    rows = out.collect()
    size = Counter()
    for r in rows:
        assert r["mix_size"] == len(cases.words(r["text"])) and 0 <= r["mix_repeats"] <= 3
        size[r["source"]] += r["mix_size"]
    names = sorted(x for x in size if x is not None) + [None]
    weight = {x: 1 + i % 3 for i, x in enumerate(names)}
    target, free, left = {}, set(names), sum(size.values())
    while True:
        share = {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        over = [x for x in free if share[x] > 3 * size[x]]
        if not over:
            break
        for x in over:
            target[x] = 3 * size[x]
            left -= target[x]
            free.remove(x)
    target |= share
    for r in rows:
        assert r["mix_target"] == pytest.approx(target[r["source"]])
    again = mixing.mix_sources(docs.repartition(5))
    assert got(out, "doc_id", "mix_repeats") == got(again, "doc_id", "mix_repeats")
    assert mixing.repeated(out).count() == sum(r["mix_repeats"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_meets_targets_of_many_documents(spark):
    df = spark.range(40_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("s"), (F.col("id") % 7 % 4).cast("string")).alias("source"),
        F.repeat(F.lit("w "), (1 + F.col("id") % 13).cast("int")).alias("text"),
    )
    taken = mixing.mix_sources(df).groupBy("source").agg(
        F.sum(F.col("mix_size") * F.col("mix_repeats")).alias("taken"), F.first("mix_target").alias("target")
    )
    for r in taken.collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.005)


def test_columns_with_the_names_of_helpers_stay(docs):
    helpers = ("mix_source", "MIX_Place", "mix_whole", "mix_cut", "mix_copy", "lang_has_letter")
    clashing = docs.withColumns({h: F.lit(f"{h} of the user") for h in helpers})
    plain = got(mixing.repeated(mixing.mix_sources(docs)), "doc_id", "mix_size", "mix_repeats")
    out = mixing.repeated(mixing.mix_sources(clashing))
    assert got(out, "doc_id", "mix_size", "mix_repeats") == plain
    rated = langid.predict_languages(clashing, langid.fit_languages(clashing))
    for df in (out, rated):
        assert got(df.select(*helpers).distinct(), *helpers) == [tuple(f"{h} of the user" for h in helpers)]


def test_hot_source_does_not_move_documents(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_lm_baseline_and_score(docs, empty):
    learn = ~queries.held_out("doc_id", 7)
    out = lm.score_texts(docs, learn)
    train = [cases.words(t, True) for id, t in PAIRS if cases.checksum(id) % 7 != 2]
    count = Counter(w for t in train for w in t)
    n = sum(count.values()) + len(train)
    v = len(count) + 1
    expected = []
    for id, text in PAIRS:
        w = cases.words(text, True)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        base += math.log10((len(train) + 1) / (n + v + 1))
        expected.append((id, len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, round(base, 6)))
    rows = out.collect()
    mine = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]
    assert cases.ordered(mine) == cases.ordered(expected)
    assert all(r["score"] < 0 and math.isfinite(r["bits_per_byte"]) for r in rows)
    long = [r for r in rows if r["n_tokens"] > 10_000]
    assert all(r["score"] > r["base_score"] for r in long)
    assert lm.score_texts(empty, learn).count() == 0


def test_top_k(spark, empty):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(700, 6)).astype(np.float32)
    vectors[50] = vectors[51] = vectors[100]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(900, None), (1000, [float("nan")] * 6), (1001, [None] * 6), (None, data[0][1]), (1100, [1.0, 2.0]), (1200, [])]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>")
    ints = df.select("vec_id", topk.scaled(F.col("embedding")).alias("embedding"))
    out = topk.top_k(ints, ints.where("vec_id % 100 = 0"))
    whole = np.floor(1024 * vectors.astype(float)).astype(int)
    expected = []
    for q in range(0, 700, 100):
        scores = sorted((-int(whole[q] @ whole[i]), i) for i in range(700) if i != q)
        expected += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:10])]
    assert got(out, "query_id", "rank", "vec_id", "score") == cases.ordered(expected)
    none = ints.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_shards(docs, empty):
    rows = sharding.shard_documents(docs, shards=4).collect()
    assert len(rows) == len(PAIRS)
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert cases.ordered((r["doc_id"], r["size"]) for r in rows) == cases.ordered(
        (id, len((t or "").encode()) + 1) for id, t in PAIRS
    )
    assert sharding.shard_documents(empty).count() == 0


def test_shards_are_balanced_with_a_large_group(spark):
    df = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("same text here")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"),
    )
    out = sharding.shard_documents(df)
    loads = [tuple(r) for r in out.groupBy("shard").agg(F.sum("size"), F.sum("n_tokens"), F.count("*")).collect()]
    assert len(loads) == 16
    for column in list(zip(*loads, strict=True))[1:]:
        assert max(column) < 1.02 * sum(column) / 16


@pytest.mark.parametrize("missing", [0, 3, 6, 9])
def test_shards_are_balanced_with_missing_texts(spark, missing):
    text = F.concat(F.repeat(F.lit("word "), (F.col("id") % 37).cast("int")), F.col("id").cast("string"))
    gone = F.pmod(F.xxhash64("id"), F.lit(10)) < missing
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(~gone, text).alias("text"))
    out = sharding.shard_documents(df)
    loads = [tuple(r) for r in out.groupBy("shard").agg(F.sum("size"), F.count("*")).collect()]
    for place, room in ((1, 1.01), (2, 1.02)):
        column = [r[place] for r in loads]
        assert len(column) == 16
        assert max(column) < room * sum(column) / 16 and min(column) > (2 - room) * sum(column) / 16


def test_shards_equal_packing_one_group_at_a_time(docs):
    """Equal texts share a shard, checksums are right, and the packing is the plain rule."""
    rows = sharding.shard_documents(docs, shards=4).collect()
    texts = Counter((id, len((t or "").encode()) + 1, cases.zlib.crc32((t or "").encode())) for id, t in PAIRS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    at: dict[int, set] = {}
    for r in rows:
        at.setdefault(r["text_crc32"], set()).add(r["shard"])
    total = [sum(r[k] for r in rows) for k in ("size", "n_tokens")] + [len(rows)]
    for crc, shards in at.items():
        own = [r for r in rows if r["text_crc32"] == crc]
        shares = [sum(r[k] for r in own) / t for k, t in zip(("size", "n_tokens"), total, strict=False)]
        if max(*shares, len(own) / len(rows)) <= sharding.HEAVY:
            assert len(shards) == 1

    rng = np.random.default_rng(5)
    loads = rng.integers(0, 50, (200, 3)).astype(float)
    parts = loads / loads.sum(axis=0) * 4
    room = [[1.0] * 3 for _ in range(4)]
    expected = [0] * 200
    for u in sorted(range(200), key=lambda u: (-max(parts[u]), u)):
        scores = [sum(a * b for a, b in zip(left, parts[u], strict=True)) for left in room]
        fits = [s for s in range(4) if all(a >= b - 1e-12 for a, b in zip(room[s], parts[u], strict=True))]
        best = max(fits or range(4), key=lambda s: (scores[s], -s))
        expected[u] = best
        room[best] = [a - b for a, b in zip(room[best], parts[u], strict=True)]
    assert sharding.place_units(loads, 4).tolist() == expected


def test_packing(docs, empty):
    library = Tokenizer.from_file(BYTES)
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in PAIRS]
    rows = packing.pack_documents(docs, BYTES).collect()
    expected = []
    for (id, _), x in zip(PAIRS, ids, strict=True):
        first = (len(x) - 1) % 1024 + 1
        cuts = [0, *range(first, len(x) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected.append((id, k, a, b - a, packing.zlib.crc32(np.array(x[a:b], "<u4").tobytes())))
    assert cases.ordered(tuple(r)[:5] for r in rows) == cases.ordered(expected)
    filled: dict[int, list] = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(filled) <= -(-sum(map(len, ids)) // 1024) + 1
    assert packing.pack_documents(empty, BYTES).count() == 0


def test_ids_of_long_white_space_are_those_of_the_library():
    library = Tokenizer.from_file(BYTES)
    for text in (" " * 2_000_000, "a" + "\n" * 1_500_000 + "<|endoftext|> b"):
        expected = library.encode(text, add_special_tokens=False).ids
        assert packing.token_ids(BYTES, text, 2).tolist() == [*expected, 2]


def test_plan_is_best_fit():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 101, 3000).tolist()
    plan = packing.best_fit_plan(Counter(lengths), 100)
    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(100 - x)
        else:
            rooms[rooms.index(fit)] -= x
    opened = set()
    for x, first, sequence, _ in zip(*(plan[k] for k in ("length", "rank", "sequence", "offset")), strict=True):
        following = [r for l, r in zip(plan["length"], plan["rank"], strict=True) if l == x and r > first]
        opened.update(range(sequence, sequence + min(following, default=lengths.count(x)) - first))
    assert len(opened) == len(rooms)
