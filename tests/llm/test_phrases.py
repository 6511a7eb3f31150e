"""Collocations against counting every phrase, and the index against its text."""

import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import cases
from areacast.llm import phrases
from areacast.llm.phraseindex import PhraseIndex

LOWER = str.maketrans({chr(b): chr(b + 32) for b in range(65, 91)})


def expected(data, least=10, share=50, top=2000):
    counts, totals = {}, Counter()
    for text, lang in data:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\t]+", piece)
            totals[lang or "und"] += len(w)
            f.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        longer, rows = Counter(), []
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        for p, a in f.items():
            if len(p) == 1 or a < least or 100 * longer[p] >= share * a:
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return out


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def data():
    rows = [(r[1], r[2]) for r in cases.rows()]
    rows += [("New York, new york! NEW\tYork  is big\r\nÄÖ ß\x00x", "en")] * 12
    rows += [("a a a a a a a b\n" * 9 + "of the house.of the house", None)] * 3
    rows += [("x y z w " * 30, "und"), ("　 \x1c \x85 z " * 12, "de"), ("", "fr"), (None, "it"), (".,;", "pt")]
    return rows


def frame(spark, rows):
    extra = [(t, lang, "k", 1, 2) for t, lang in rows]
    return spark.createDataFrame(extra, "text string, lang string, word string, shard int, n int")


def test_collocations_equal_counting(spark):
    out = phrases.collocations(frame(spark, data()).repartition(3))
    assert out.columns == list(COLUMNS)
    assert cases.ordered(tuple(r) for r in out.collect()) == cases.ordered(expected(data()))


def test_collocations_over_many_shards(spark):
    out = phrases.collocations(frame(spark, data() * 2).repartition(11), least=3, share=70, top=40)
    assert cases.ordered(tuple(r) for r in out.collect()) == cases.ordered(expected(data() * 2, 3, 70, 40))


def test_no_documents(spark):
    assert phrases.collocations(cases.frame(spark, [])).count() == 0


def test_scores_do_not_overflow(spark):
    row = spark.createDataFrame([(3_000_000_000_000, 7_000_000_000_000, 9_000_000_000_001)], "a long, l long, r long")
    got = row.select(phrases._exact("a", "l", "r")).first()[0]
    assert got == 1_000_000 * 3_000_000_000_000**2 // (7_000_000_000_000 * 9_000_000_000_001)


def test_intervals_are_extended_both_ways():
    r = np.random.default_rng(2)
    text = np.where(r.random(4000) < 0.1, 0, r.integers(1, 12, 4000))
    index = PhraseIndex(text, 12, 4)
    words = [int(x) for x in text]

    def counted(k):
        grams = (tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        return Counter(g for g in grams if 0 not in g)

    word, f, b, n = index.words()
    names = [(int(w),) for w in word]
    for way in ("right", "left", "right"):
        parent, word, f, b, n = getattr(index, way)(f, b, n)
        pairs = zip(parent.tolist(), word.tolist(), strict=True)
        names = [(*names[p], w) if way == "right" else (w, *names[p]) for p, w in pairs]
        assert dict(zip(names, n.tolist(), strict=True)) == counted(len(names[0]))
