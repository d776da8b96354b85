import random

import pytest

import corpus_pipeline as P
from hertzflow.llm.queries import vocabulary
from hertzflow.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    syllables = ["an", "the", "or", "ti", "on", "re", "é", "ch", "st", "ing", "ou", "ble"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs, labels = {}, {}
    for i in range(300):
        text = prose(rng.randint(30, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["idiot", "scum", "moron"])
        docs[i], labels[i] = " ".join(text), int(toxic)
    item = prose(25)
    planted = {"copy": 1001, "near": 1002, "contaminated": 1003, "repeat": 1004, "empty": 1005, "null": 1006, "toxic": 1007, "piece": 1008}
    docs[1001] = docs[1]
    words = prose(90).split()
    docs[1000] = " ".join(words)
    words[40] = "changed"
    docs[1002] = " ".join(words)
    docs[1003] = prose(20) + " " + item.replace(" ", ", ") + " " + prose(20)
    passage = prose(60)
    docs[999], docs[1004] = prose(30) + passage + prose(30), prose(30) + passage + prose(30)
    docs[1005], docs[1006], docs[1007] = "", None, prose(20) + " idiot moron scum " + prose(20)
    docs[1008] = docs[999][40:300]
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, labels, planted, passage


def test_planted_cases_and_clean_documents(spark, folder):
    path, docs, labels, planted, passage = folder
    rows = {r.doc_id: r for r in P.run(spark, path).collect()}
    gone = set(docs) - set(rows)
    toxic = {i for i, y in labels.items() if y} | {planted["toxic"]}
    must = {planted[k] for k in ("copy", "near", "contaminated", "piece")}
    assert must <= gone and len(toxic & gone) > 0.9 * len(toxic)
    assert len(gone - must - toxic) <= 0.03 * len(docs)
    assert {planted["empty"], planted["null"], planted["repeat"]} <= set(rows)
    assert passage[10:-10] not in rows[planted["repeat"]].text and passage in rows[999].text
    words = vocabulary()
    for i, r in rows.items():
        assert bpe.decode_ids(words, bytes(r.token_ids)).decode() == r.text and r.n_tokens * 4 == len(r.token_ids)
        if i != planted["repeat"]:
            assert r.text == (docs[i] or "")


def test_stages_keep_the_columns_and_stand_an_empty_table(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, step in P.STAGES:
        out = step(spark, docs, path)
        assert name == "tokens" or out.columns == docs.columns
        assert out.count() == 0
