import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from hertzflow.llm import alignment
from hertzflow.llm.queries import QUERIES, two_tokenizers


@pytest.fixture(scope="module")
def own():
    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    return a, b, *alignment.vocabularies(a, b)


def groups_of(own, text):
    """Brute force: whole texts, ends as sets. None where there are no tokens."""
    a, b, a_bytes, b_bytes = own
    if not text:
        return None
    raw = (" " + text).encode()
    sides = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if any(b"".join(v[i] for i in ids) != raw for ids, v in zip(sides, (a_bytes, b_bytes), strict=True)):
        return None
    ends = []
    for ids, v in zip(sides, (a_bytes, b_bytes), strict=True):
        at, out = 0, {}
        for i in ids:
            at += len(v[i])
            out[at] = i
        ends.append(out)
    groups, last = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        groups.append([[i for e, i in side.items() if last < e <= end] for side in ends])
        last = end
    return groups


def expected(own, texts):
    found = [groups_of(own, t) for t in texts]
    count = Counter((g[0][-1], g[1][-1]) for groups in found for g in groups or [])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for groups in found:
        if groups is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in groups]
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        best = sum(count[x] == top[x[1]] for x in links)
        n_a, n_b = (sum(len(g[k]) for g in groups) for k in (0, 1))
        out.append((n_a, n_b, len(groups), len(links), best, sum(count[x] for x in links), hashlib.sha256(written.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def samples():
    rng = random.Random(8)
    letters = "aeiouthnrs   \n\t'é漢😀\x1c\x85　᠎▁ßЖ07.,;-<> \xa0"
    words = ["hello", "world", "internationalisation", "it's", "naïve", "<|endoftext|>", "</s>", "<0x41>", "漢字", "1234", "--", "Ünïcode", "straße"]
    out = [None, "", " ", "a", "a  b", " a", "a ", "▁x", "x" * 300, "ab " * 90, "\x00", "hello world"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(120)]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    return out


@pytest.mark.parametrize("size,context,fan", [(1 << 16, 1 << 13, 16), (5, 30, 2), (23, 3, 3), (64, 10, 16)])
def test_equals_brute_force(spark, own, monkeypatch, size, context, fan):
    for name, value in (("CHUNK", size), ("CONTEXT", context), ("FAN_IN", fan)):
        monkeypatch.setattr(alignment, name, value)
    texts = samples()
    df = spark.createDataFrame([(i + (1 << 53), t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    out = alignment.align(df, two_tokenizers()).collect()
    got = {r.doc_id - (1 << 53): tuple(r[c] for c in COLUMNS) for r in out}
    assert len(out) == len(texts)
    for i, want in enumerate(expected(own, texts)):
        assert got[i] == want, (i, texts[i])


def test_ranges_cover_the_text():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab  é漢\n") for _ in range(rng.randint(1, 90)))
        for size, context in ((1, 5), (7, 4), (20, 40)):
            at, whole = 0, (" " + text).encode()
            for body, skip, take in alignment.chunks(text, size, context):
                raw = (" " + body).encode()
                assert raw[skip : skip + take] == whole[at : at + take]
                at += take
            assert at == len(whole)


def test_composition_is_associative():
    rng = random.Random(1)

    def fragment(chunk):
        cut = rng.random() < 0.6
        ids = lambda: [rng.randint(0, 9) for _ in range(rng.randint(0, 2))]
        return {"_row": 0, "_chunk": chunk, "_at": chunk, "_cut": cut, "pa": ids(), "pb": ids(), "sa": ids() if cut else [], "sb": ids() if cut else []}

    for _ in range(300):
        x, y, z = (fragment(i) for i in range(3))
        xy, one = alignment.compose(x, y)
        left, two = alignment.compose(xy, z)
        yz, three = alignment.compose(y, z)
        right, four = alignment.compose(x, yz)
        if not (x["_cut"] or y["_cut"] or z["_cut"]):
            left["_at"] = right["_at"]
        assert left == right
        assert sorted(g for g in (one, two) if g) == sorted(g for g in (three, four) if g)


def test_pairs_are_bounded_by_the_vocabularies(own):
    bound = alignment.pair_bound(own[2], own[3])
    assert alignment.pair_bound([b"ab", b"b"], [b"b", b"xab", b"c"]) == 4
    assert bound < 500_000, bound


def test_repeated_rows_and_null_ids(spark, own, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 40)
    monkeypatch.setattr(alignment, "POOL", 3)
    text = "some words and internationalisation of them all, again and again"
    rows = [(None, text), (None, "other words, but longer than forty bytes, too"), (5, text), (5, text), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = alignment.align(df, two_tokenizers(), others=("text",)).collect()
    want = dict(zip([t for _, t in rows], expected(own, [t for _, t in rows]), strict=True))
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted((i or 0, t or "") for i, t in rows)
    assert all(tuple(r[c] for c in COLUMNS) == want[r.text] for r in out)
    assert alignment.align(df.limit(0), two_tokenizers()).count() == 0


def test_query(spark, own, tmp_path):
    texts = ["hello world", None, "hello there, world"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_alignment"](spark, str(tmp_path))
    assert out.columns == ["doc_id", *COLUMNS]
    assert [tuple(r)[1:] for r in out.orderBy("doc_id").collect()] == expected(own, texts)
