"""Registered queries against their SQL, and the pipeline against its stages' meaning."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases
import corpus_pipeline
from areacast.llm.oracles import ORACLES
from areacast.llm.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert cases.ordered(rows) == cases.ordered(expected)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op2_language_id"](spark, FOLDER).join(docs, "doc_id").where("held_out and lang is not null")
    rows = out.collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)


def test_pipeline_stages(spark, tmp_path):
    docs = cases.frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
    pairs = [r[:2] for r in cases.rows()]
    lettered = [(id, t) for id, t in pairs if t and any(c.isalpha() for c in t)]
    assert cases.ordered(tuple(r)[:2] for r in kept[0]) == cases.ordered(lettered)
    groups = cases.jaccard(lettered)
    alone = {(id, t) for (id, t), (_, _, c) in zip(lettered, groups, strict=True) if id is None or id == c}
    assert cases.ordered(tuple(r)[:2] for r in kept[1]) == cases.ordered(alone)
    removed = {r[0]: r[2] for r in cases.without_repeats([p for p in alone if p[0] is not None])}
    before = {r["doc_id"]: len(cases.words(r["text"])) for r in kept[1]}
    for r in kept[2]:
        if r["doc_id"] is not None:
            assert len(cases.words(r["text"])) == before[r["doc_id"]] - removed[r["doc_id"]]
            assert r["n_chars"] == len(r["text"])
    repeats = {}
    for r in kept[3]:
        repeats[r["doc_id"]] = repeats.get(r["doc_id"], 0) + 1
    assert max(repeats.values()) <= 3
    assert {r["doc_id"] for r in kept[4]} == set(repeats)


def test_pipeline_rejects_by_the_raw_language_score(spark):
    en = "the river walks under a green house in the morning {}"
    de = "der fluss geht unter dem haus und ist am morgen {}"
    data = [(i, (en if i % 2 else de).format("abc"[i % 3] * (i % 5 + 1)), ["de", "en"][i % 2]) for i in range(60)]
    data += [(100, "привет мир как дела сегодня вечером", None), (101, "the house under the river", None), (102, "123", None)]
    docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, FOLDER).collect()}
    assert kept == {*range(60), 101}
    unlabelled = docs.where("lang is null")
    assert corpus_pipeline.language_id(spark, unlabelled, FOLDER).count() == 3


def test_pipeline_drops_near_copies_by_their_own_text(spark):
    words = [f"w{i}" for i in range(80)]
    near, own = " ".join([*words, "x"]), " ".join(f"v{i}" for i in range(50))
    data = [(1, " ".join(words)), (2, near), (2, own), (2, own), (3, own + " y")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted(kept) == [(1, " ".join(words)), (2, own)]


def test_pipeline_of_nothing(spark, tmp_path):
    docs = cases.frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_pipeline_stages_keep_columns_with_the_names_of_helpers(spark, tmp_path):
    docs = cases.frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    names = ("copy", "text_hash", "text_key", "kept_text", "input_hash", "mix_source", "lang_has_letter")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, docs, FOLDER)
        out = stage(spark, docs.withColumns({c: corpus_pipeline.F.lit("own") for c in names}), FOLDER)
        assert {tuple(r) for r in out.select(*names).distinct().collect()} == {("own",) * len(names)}
        assert cases.ordered(map(tuple, out.select(*plain.columns).collect())) == cases.ordered(
            map(tuple, plain.collect())
        )
