import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tarnbeck.llm.bpe import Encoder, decode, default_vocabulary, encode  # noqa: E402


@pytest.fixture(scope="module")
def encoder():
    return Encoder.from_file(default_vocabulary())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ours(encoder, texts):
    flat, off = encoder.encode_batch(texts)
    return [flat[a:b].tolist() for a, b in zip(off, off[1:])]


def test_compatible_is_what_merging_says(encoder):
    rng = np.random.default_rng(1)
    text = {v: k for k, v in encoder.ranks.items()}
    a, b = rng.integers(0, len(text), 4000), rng.integers(0, len(text), 4000)
    cut = [(w, rng.integers(1, len(w))) for w in list(text.values())[300:6000:3] if len(w) > 1]
    pairs = [(x, y) for w, k in cut for x, y in [(encoder.ranks.get(w[:k]), encoder.ranks.get(w[k:]))] if x is not None and y is not None]
    a, b = np.append(a, [p[0] for p in pairs]), np.append(b, [p[1] for p in pairs])
    want = [encoder.exact(text[x] + text[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert encoder.compatible(a, b).tolist() == want and not all(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn")), max_size=40), st.text(alphabet="ab '  \n\tllre中文字12", max_size=60)), max_size=6))
def test_same_ids_as_the_library(encoder, library, texts):
    want = [library.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    assert ours(encoder, texts) == want


def test_long_words_and_special_strings(encoder, library):
    texts = ["a" * 20_000, "中" * 5000, " " * 3000, "<|endoftext|>", "x\r\n\r\n y", "ab" * 3000, None, "", "é́"]
    assert ours(encoder, texts) == [library.encode(t, add_special_tokens=False).ids if t else [] for t in texts]


def test_frame(spark, library):
    rows = [(1, "hello 世界", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "长" * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode(df, "text")
    assert dict(out.dtypes)["ids"] == "array<int>" and set(out.columns) == {"doc_id", "ids"}
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got[2] == got[3] == [] and got[1] == library.encode(rows[0][1]).ids and out.count() == len(rows)
    assert library.decode(got[4]) == rows[4][1]
    assert {r["doc_id"]: r["n"] for r in encode(df, "text", "n", count_only=True).collect()} == {k: len(v) for k, v in got.items()}
    assert encode(df.limit(0), "text").count() == 0


def test_decode_gives_the_text_back(spark):
    texts = ["苹果 juice\n\t🙂", "", "a" * 5000, "é𩽾　x", "苹果 juice\n\t🙂"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    assert {r["id"]: r["text"] for r in decode(encode(df)).collect()} == dict(enumerate(texts))
    odd = spark.createDataFrame([(1, None), (2, [])], "id int, ids array<int>")
    assert {r["id"]: r["text"] for r in decode(odd).collect()} == {1: None, 2: ""} and decode(odd.limit(0)).count() == 0
