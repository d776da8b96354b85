import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from hertzflow.llm import bpe
from hertzflow.llm.queries import vocabulary


def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples():
    rng = random.Random(5)
    alphabet = "aeiouthn  \n\t'sdé漢😀\x1c\x85　᠎0987.,;ßЖ'll\r"
    out = ["", " ", "a", "hello world", "<|endoftext|>", "   x", "x   ", "\r\n\r\n a", "it's we'll THEY'LL"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(300)]
    out += ["ab" * 3000, "a" * 700, "é" * 600, "the quick brown " * 3000]
    return out


def test_equals_tiktoken_and_round_trips(spark):
    texts = [None, *samples()]
    df = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, token_ids binary")
    words, own = vocabulary(), reference()
    rows = bpe.decode(bpe.encode(df.repartition(3), words), words).select("doc_id", "token_ids", "decoded").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        want = own.encode_ordinary(text)
        assert [int.from_bytes(r.token_ids[i : i + 4], "little") for i in range(0, len(r.token_ids), 4)] == want, text
        assert bytes(r.decoded) == text.encode()


def test_long_texts_are_encoded_in_runs(monkeypatch):
    words, own = vocabulary(), reference()
    monkeypatch.setattr(bpe, "RUN_PIECES", 50)
    text = "some words, 123 and more; " * 60
    (ids, other) = bpe.encode_texts(words, [text, "x y"])
    assert len(ids) == 4 * len(own.encode_ordinary(text)) and len(other) == 8
    assert bpe.decode_ids(words, ids) == text.encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, vocabulary()).count() == 0


def test_query(spark, tmp_path):
    texts = ["a b", None, "a b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from hertzflow.llm.queries import QUERIES

    for r in QUERIES["op3_byte_bpe"](spark, str(tmp_path)).collect():
        want = reference().encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
