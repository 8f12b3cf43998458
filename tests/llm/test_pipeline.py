import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from llm_support import documents, sentence
from test_decontamination import brute_force as contaminated
from test_lines import key
from test_ngram_join import brute_force as groups_of
from postweave.llm.piece_encoding import codec
from postweave.llm.queries import vocabulary

BASE = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents that each stage has something to do with."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [None, "", "123 456"]
    texts += ["Shared line of all.\n" + sentence(rng, 60, 900) for _ in range(12)]
    texts += [sentence(rng, 80, 900)] * 3 + [sentence(rng, 40, 900) + " " + passage for _ in range(4)]
    near = sentence(rng, 100, 900)
    texts += [near, near + " more", near + " and more"]
    texts += ["Shared line of all."]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = documents(spark, texts).select(*BASE)
    docs.write.parquet(f"{path}/documents.parquet")
    items = [(1, passage), (2, "never seen words of an item that is not in any document")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, items


def lines_of(texts, least):
    """Texts without lines that ``least`` documents have; the first of these keeps its first one."""
    firsts, counts = {}, {}
    for i, text in enumerate(texts):
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            firsts.setdefault(k, i)
            counts[k] = counts.get(k, 0) + 1
    found = {}
    for i, text in enumerate(texts):
        kept, seen = [], set()
        for line in (text or "").split("\n"):
            k = key(line)
            if not k or counts[k] < least or firsts[k] == i and k not in seen:
                kept.append(line)
            seen.add(k)
        found[i] = (0, len((text or "").split("\n")) - len(kept), "\n".join(kept))
    return found


def test_run_equals_brute_force(spark, folder):
    path, texts, items = folder
    left = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    kept = lines_of([left.get(i) for i in range(len(texts))], 10)
    left = {i: kept[i][2] for i in left if kept[i][2].strip() or not kept[i][1]}
    groups = groups_of([left.get(i) for i in range(len(texts))])
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    hit = contaminated([left.get(i) for i in range(len(texts))], items)
    left = {i: t for i, t in left.items() if not hit[i][1]}
    assert 10 < len(left) < 16
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert found.keys() == left.keys()
    library = codec(vocabulary("piece_bpe_32k.model")).library
    for i, text in left.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(found[i]["ids"], "<u4").tolist() == ids and found[i]["n_tokens"] == len(ids)
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).dtypes == docs.dtypes
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language ID"


def test_stages_take_odd_rows(spark, folder):
    docs = documents(spark, ["Some words here", None, "Some words here", ""])
    odd = docs.union(docs).union(docs.selectExpr("cast(null as bigint)", *docs.columns[1:]))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, folder[0]).count() >= 1
        assert stage(spark, odd.filter("false"), folder[0]).count() == 0
