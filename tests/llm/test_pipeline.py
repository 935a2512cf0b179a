"""The pipeline's stages against plain Python, one by one and all together."""

import collections
import re

import corpus_pipeline
import pytest

from cartoflow.llm.common import staged

SPACE = r"[\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf), f"test-{name}")
        out.append(docs)
    return [d.toPandas() for d in out]


def test_columns(stages):
    assert all(list(d.columns) == list(stages[0].columns) for d in stages[:-1])


def test_language_id(stages):
    a, b = stages[0], stages[1]
    letters = {i for i, t in zip(a.doc_id, a.text, strict=True) if t and any(c.isalpha() for c in t)}
    assert set(b.doc_id) == letters


def test_exact(stages):
    a, b = stages[1], stages[2]
    first: dict = {}
    for i, t in sorted(zip(a.doc_id, a.text, strict=True)):
        first.setdefault(re.sub(SPACE, " ", t), i)
    assert sorted(b.doc_id) == sorted(first.values())


def test_near(stages):
    a, b = stages[2], stages[3]
    sets = {}
    for i, t in zip(a.doc_id, a.text, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    held = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    root = {i: i for i in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in sets:
        for j, n in collections.Counter(j for x in sets[i] for j in held[x] if j < i).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert sorted(b.doc_id) == sorted({find(i) for i in sets})


def test_mix(stages):
    a, b = stages[3], stages[4]
    assert set(b.doc_id) <= set(a.doc_id) and b.doc_id.value_counts().max() <= 3


def test_pack(stages):
    a, b = stages[4], stages[5]
    copies = a.doc_id.value_counts()
    for doc_id, rows in b.groupby("doc_id"):
        assert rows.length.sum() == rows.doc_tokens.iloc[0] * copies[doc_id]
    assert set(b.doc_id) == set(a.doc_id) and b.groupby("sequence_id").length.sum().max() <= 1024


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == len(stages[-1])


def test_odd_rows_pass_every_stage(spark, docs, empty, clash, texts):
    letters = sorted(t for _, t, *_ in texts if t and any(c.isalpha() for c in t))
    results = []
    for table in (empty, docs, clash):
        rows, out = table, []
        for name, stage in corpus_pipeline.STAGES:
            rows = staged(stage(spark, rows, ""), f"test-{name}")
            out.append(rows.toPandas())
        results.append(out)
    assert all(len(x) == 0 for x in results[0])
    assert [len(x) for x in results[1]][:4] == [len(x) for x in results[2]][:4]
    assert list(results[2][3].columns) == clash.columns
    lang, exact, near = results[1][:3]
    assert sorted(lang.text) == letters
    assert len(exact) == len({re.sub(SPACE, " ", t) for t in letters}) and 7 in set(exact.doc_id) and 8 not in set(exact.doc_id)
    assert {5, 7, 10, 11} <= set(near.doc_id) and not {6, 9, 18} & set(near.doc_id)


def test_one_id_with_different_texts(spark):
    """Rows of one id and unrelated texts are documents of their own."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (2, a + " tail"), (3, "alone here"), (1, a), (None, b), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near(spark, docs, "").collect()
    assert sorted(r.text for r in got) == sorted([a, b, "alone here", "null id"])
    assert {r.doc_id for r in got if r.text in (a, b)} == {1}
    assert len(corpus_pipeline.exact(spark, docs, "").collect()) == 5
