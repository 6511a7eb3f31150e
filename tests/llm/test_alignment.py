"""Cross-tokenizer alignment against whole-text encodings walked token by token."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import cases
from areacast.llm import alignment
from areacast.llm.packing import byte_letters

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (500, " "), (501, "  "), (502, "a  b "), (503, " \n a\t\n b\r\n\r\nc;\r"), (504, "x▁y is lost"),
    (505, "<s> </s> <unk> <0x41> <|endoftext|> plain"), (506, "\x00 \x1c \x85 　 ​ z"),
    (507, "日本語のテキスト 汉字 😀😀 café"), (508, "a" * 3000), (509, " " * 5000 + "end" + "\n" * 3000),
    (510, "I'll don't 's 've 12345 3.14 ___ !!!  ??"), (None, "I'll don't twice"), (510, "I'll don't twice"),
    (511, "word " * 40), (512, "tail\n "), (513, "é" * 50 + " " + "ß" * 3),
]


def expected(data):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_letters()

    def walked(text):
        a = first.encode(" " + text, add_special_tokens=False)
        ends_a, ends_b, at = [], [], 0
        ids_a, tokens = a.ids, a.tokens
        whole_a = b"".join(bytes(letters[c] for c in t) for t in tokens)
        for t in tokens:
            at += len(t)
            ends_a.append(at)
        ids_b, whole_b = second.encode(text), b""
        for i in ids_b:
            piece = second.id_to_piece(i)
            whole_b += bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()
            ends_b.append(len(whole_b))
        if not whole_a == whole_b == (" " + text).encode():
            return None
        links, groups, group, i, j = [], [], ([], []), 0, 0
        while i < len(ends_a):
            links.append((ids_a[i], ids_b[j]))
            x, y = ends_a[i], ends_b[j]
            if x <= y:
                group[0].append(str(ids_a[i]))
                i += 1
            if y <= x:
                group[1].append(str(ids_b[j]))
                j += 1
            if x == y:
                groups.append(",".join(group[0]) + "|" + ",".join(group[1]))
                group = ([], [])
        return len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    made = [walked(text) if text else None for _, text in data]
    counts = Counter(link for m in made if m for link in m[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for (id, _), m in zip(data, made, strict=True):
        if m is None:
            out.append((id, 0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(counts[link] == highest[link[1]] for link in m[3])
        out.append((id, *m[:3], len(m[3]), best, sum(counts[link] for link in m[3]), m[4]))
    return out, {(b, a): (n, n == highest[b]) for (a, b), n in counts.items()}


def check(df, data):
    out, pairs = alignment.align_tokenizers(df, A, B)
    documents, counts = expected(data)
    assert cases.ordered(tuple(r) for r in out.select(*COLUMNS).collect()) == cases.ordered(documents)
    assert {(r["b"], r["a"]): (r["n"], r["best"]) for r in pairs.collect()} == counts


def test_alignment_equals_a_walk_over_whole_texts(spark):
    data = [r[:2] for r in cases.rows()] + ODD
    extra = [(*r, "x", 1, 2, b"") for r in data]
    df = spark.createDataFrame(extra, "doc_id long, text string, run string, place int, bucket int, totals binary")
    check(df.repartition(3), data)


def test_alignment_over_many_runs_and_split_partitions(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 2000)
    data = [r[:2] for r in cases.rows(5)] * 2 + ODD
    one = alignment.aligner(A, B)
    one.forget()
    check(spark.createDataFrame(data, "doc_id long, text string").repartition(9), data)


def test_chunks_give_the_ids_of_the_whole_text():
    one = alignment.aligner(A, B)
    for _, text in ODD:
        one.forget()
        one.chunked(text)
        chunks = list(one.numbers)
        order = [chunks[i] for i in one.chunked(text)]
        assert "".join(" " + c for c in order) == " " + text
        assert [i for c in order for i in one.ids_a(c)] == one.a.encode_ordinary(" " + text)
        assert [i for ids in one.ids_b(order) for i in ids] == one.b.encode(text)
    one.forget()


def test_a_long_run_of_blanks_or_line_ends(spark):
    data = [(1, " " * 1_200_000), (2, "x" + "\n" * 1_200_000)]
    out, _ = alignment.align_tokenizers(spark.createDataFrame(data, "doc_id long, text string"), A, B)
    first = Tokenizer.from_file(A)
    rows = {r["doc_id"]: r for r in out.collect()}
    for id, text in data:
        assert rows[id]["n_a"] == len(first.encode(" " + text, add_special_tokens=False).ids)


def test_no_documents(spark):
    out, pairs = alignment.align_tokenizers(cases.frame(spark, []), A, B)
    assert out.count() == pairs.count() == 0
