"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from siftline.llm import spelling


def plain_words(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_forms(words):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def as_dict(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    out = {r["word"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_all_pairs_on_documents(spark):
    rng = random.Random(3)
    letters = "abé×x"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["aaaaaaa", "ababababa", "ÀÀÀÀÀ", "àààààà"]
    docs = []
    for key in range(120):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = rng.choice(base)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice(letters), w[at] * 2]) + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((key, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    docs += [(None, docs[3][1]), (None, None), (7, ""), docs[5], docs[5], (500, "abéab " * 300_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    want = plain_forms(plain_words(docs))
    got = as_dict(spelling.group_variants(table))
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20
    assert any(v[1] not in (w, v[0]) for w, v in want.items())


def test_equals_all_pairs_on_dense_words(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 10))): rng.randint(3, 50) for _ in range(500)}
    words |= {"a" * k: 1000 // k for k in range(5, 14)}
    got = as_dict(spelling.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_forms(words)


def test_long_chain_of_forms(spark):
    words = {"a" * (5 + k): 3 * 2 ** k for k in range(20)}
    got = as_dict(spelling.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {v[1] for v in got.values()} == {"a" * 24}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(none).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, "abc abc"), (2, None)], none.schema)).count() == 0


@pytest.mark.parametrize("most", [1, 7, 100])
def test_pieces_keep_runs_whole(most):
    text = "abc éé  defg1h " * 9
    parts = list(spelling.pieces(text, most))
    assert "".join(parts) == text
    assert [r for p in parts for r in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


def test_pivots_are_the_lightest_disjoint_grams():
    rng = random.Random(1)
    for _ in range(300):
        prefix = [(p, rng.randint(1, 9)) for p in sorted(rng.sample(range(9), rng.randint(3, 7)))]
        pairs = [(x[1] + y[1]) for x, y in combinations(prefix, 2) if y[0] - x[0] >= 2]
        got = spelling.disjoint_pivots(prefix)
        weight = dict(prefix)
        assert got[1] - got[0] >= 2 and sum(weight[p] for p in got) == min(pairs)
