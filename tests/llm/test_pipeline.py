"""The stages, each on what the one before kept, against their contracts."""

import collections
import re
import zlib

import pandas as pd
import pytest

import corpus_pipeline
from seqloom.llm import queries
from tests.llm.test_llm import corpus, jaccard_brute, words


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pipe")
    key = "0123456789abcdef0123456789abcdef01234567"
    rows = [r for r in corpus(4, 90) if r[0] is not None]
    rows = [(r[0], (r[1] or "") + f' token = "{key}" ' if r[0] % 9 == 0 else r[1], *r[2:5]) for r in rows]
    rows += [(1000 + i, " ".join(["ZZZZ!!", "QQQQ!!"] * 40), "en", "a", 1) for i in range(20)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "int64", "n_chars": "int64"}).to_parquet(d / "documents.parquet")
    labels = [(r[0], int(r[0] < 1000), 0) for r in rows]
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("int32").astype({"doc_id": "int64"}).to_parquet(d / "labels.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "t")
        seen[name] = docs.toPandas()
    q, j, s, m, p = seen.values()
    before = pd.read_parquet(f"{folder}/documents.parquet")
    held = [i for i in before.doc_id if i < 1000 and i not in set(q.doc_id)]
    assert not held and not any(i >= 1000 for i in q.doc_id)
    brute = jaccard_brute([(r.doc_id, r.text) for r in q.itertuples()], 5, 80, 100)
    assert sorted(j.doc_id) == sorted({d for d, _, c in brute if d == c})
    assert sorted(s.doc_id) == sorted(j.doc_id) and not s.text.str.contains("0123456789abcdef", na=False).any()
    clean = s[~s.text.str.contains("[SECRET]", regex=False, na=False)].set_index("doc_id").text
    assert (clean == j.set_index("doc_id").text.loc[clean.index]).all() or clean.isna().any()
    size = {r.doc_id: len(words(r.text)) for r in s.itertuples()}
    taken = collections.Counter()
    for r in m.itertuples():
        taken[r.doc_id] += len(words(r.text))
    assert all(n <= 2 * size[d] for d, n in taken.items())
    assert list(q.columns) == list(j.columns) == list(s.columns) == list(m.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert p.groupby("sequence_id").length.sum().le(4096).all()
    tokens = p.drop_duplicates(["doc_id", "row_key"]).doc_tokens.sum()
    assert p.length.sum() == tokens and p.doc_id.nunique() == m.doc_id.nunique()


def test_run_equals_the_stages_again(spark, folder):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset", "row_key").collect())) for _ in range(2))
    assert a == b and a


def test_names():
    names = queries.queries()
    assert [n for n in range(1, 11) if not any(re.match(rf"op{n}_", k) for k in names)] == []
    assert zlib.crc32(b"1") % 5 >= 0
