from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import ODD
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_quality_rules import brute as quality
from tests.llm.test_secret_scan import base as secrets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        f(spark, docs, SF).write.parquet(path)
        kept = spark.read.parquet(path)
        out.append((name, docs, kept))
        docs = kept
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    want = pq.read_schema(f"{SF}/documents.parquet").names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "jaccard_join", "secret_scan", "packing"]
    for _, docs, kept in stages[:-1]:
        assert kept.columns == want and kept.schema == docs.schema


def test_toxic_go_and_clean_stay(stages):
    _, docs, kept = stages[0]
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    before, after = rows(docs), rows(kept)
    toxic = [i for i in before if labels.get(i) == 1]
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i not in after for i in toxic) > 0.9 * len(toxic)
    assert sum(i in after for i in clean) > 0.99 * len(clean)


def test_quality_base_is_exact(stages):
    _, docs, kept = stages[1]
    after = rows(kept)
    for i, r in rows(docs).items():
        n, _, _, _, repeated = quality(r.text)
        if n < 50 or 100 * repeated > 50 * n:
            assert i not in after
    assert len(after) > 0.5 * docs.count()


def test_one_document_of_each_group_stays(stages):
    _, docs, kept = stages[2]
    want = {c for _, c in groups([(i, r.text) for i, r in rows(docs).items()]).values()}
    assert set(rows(kept)) == want and kept.count() == len(want)


def test_secrets_are_hidden(stages):
    _, docs, kept = stages[3]
    after = rows(kept)
    assert set(after) == set(rows(docs))
    for i, r in rows(docs).items():
        if secrets(r.text):
            assert "[secret]" in after[i].text and not secrets(after[i].text)
        assert after[i].n_chars == len(after[i].text)


def test_packing_is_exact(stages):
    _, docs, kept = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in kept.collect():
        pieces[r.doc_id].append(r)
    texts = rows(docs)
    assert set(pieces) == set(texts)
    for i, ps in pieces.items():
        ids = [x for p in sorted(ps, key=lambda p: p.start) for x in np.frombuffer(p.ids, "<u2").tolist()]
        assert ids == library.encode(texts[i].text or "", add_special_tokens=False).ids + [1]


def test_stages_take_odd_and_empty_tables(spark, documents):
    odd = documents(ODD, [(None, None, None, None, None), (3, "repeated id", "en", "s", 1), (None, "no id", "en", "s", 5)])
    row = lambda r: tuple(r)
    for docs in (odd, documents([])):
        before = sorted(map(row, docs.collect()), key=repr)
        for name, f in corpus_pipeline.STAGES:
            after = sorted(map(row, f(spark, docs, SF).collect()), key=repr)
            if name == "quality_rules":
                assert all(r in before for r in after) and not any(quality(r[1])[0] < 50 for r in after)
            elif name == "jaccard_join":  # one of the two ties goes
                assert len(before) - len(after) == (1 if before else 0) and all(r in before for r in after)
                assert {r[1] for r in after} == {r[1] for r in before}
            elif name == "secret_scan":
                assert [r[0] for r in after] == [r[0] for r in before] and len(after) == len(before)
            elif name == "toxicity":
                assert after == before
            else:
                assert {r[0] for r in after} == {r[0] for r in before} and sum(r[1] == 0 for r in after) == len(before)


def test_texts_that_share_an_id_stay_apart(spark, documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    given = [(1, a), (5, b), (5, c), (5, a), (5, c + " more"), (None, b), (7, ""), (7, ""), (7, None)]
    docs = documents([], [(i, t, "en", "s", 0) for i, t in given])
    stage = dict(corpus_pipeline.STAGES)["jaccard_join"]
    kept = sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=repr)
    of_c = [t for _, t in kept if t and t.startswith(c)]
    assert len(of_c) == 1
    assert [x for x in kept if x[1] not in (c, c + " more")] == sorted([(1, a), (5, b), (7, ""), (7, ""), (7, None)], key=repr)


def test_clashing_columns_stay_as_they_are(spark, documents):
    names = ["_quality", "_toxicity", "_strong", "_weak", "_key", "_spans", "_first", "row", "changed", "score", "n_words", "component_id", "ids", "key", "a b"]
    text = " ".join(f"word{i}" for i in range(80))
    docs = documents([text, text + " more", "token = abcdefghijklmnop " + text.upper()[:0] + "other ".join(map(str, range(90)))])
    for n in names:
        docs = docs.withColumn(n, F.lit(f"kept {n}"))
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"kept {n}" for r in got for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 3
