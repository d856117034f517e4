import base64
import random
from pathlib import Path

import pytest

from finloom.llm.bpe import TOKENIZER, Encoder, decode_corpus, encode_corpus

pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="the vocabulary is not here")
SPECIAL = ["", " ", "\n\n", "a", "<|endoftext|>", "it's we'll I'D", "日本語 текст é", "\x1c\x85　x", "x" * 5000, "🙂👩‍💼", "a" * 3 + " " * 40 + "b", "0123456789" * 20]


@pytest.fixture(scope="module")
def enc():
    return Encoder(Path(TOKENIZER).read_bytes())


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(TOKENIZER).open("rb"))}
    return tiktoken.Encoding("reference", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_like_an_independent_encoder(enc, reference):
    rng = random.Random(5)
    parts = ["a", "e", "th", " ", "in", "日", "é", "x", "ing", "er", "\n", "  ", "1", "!", "🙂", "o", "nn", "ss", "'s", "'", "\t"]
    texts = SPECIAL + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        assert enc.encode(t) == reference.encode_ordinary(t), t
        assert enc.decode(enc.encode(t)) == t.encode()


def test_merge_by_merge(enc):
    """Against the procedure itself: merge the pair of least rank until none is left."""
    rng = random.Random(6)
    for _ in range(300):
        data = bytes(rng.choice(b"abcdehinrst ") for _ in range(rng.randint(1, 25)))
        parts = [bytes([b]) for b in data]
        while True:
            ranks = [(enc.id.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            if not ranks or min(ranks)[0] == 1 << 30:
                break
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert enc.encode_bytes(data) == [enc.id[p] for p in parts]


def test_corpus_round_trip(spark):
    rows = [(i, t, "x", [1]) for i, t in enumerate([None, *SPECIAL, SPECIAL[3]])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _id string, ids array<int>")
    out = encode_corpus(df)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert len(got) == len(rows) and got[0] == [] and got[1] == []
    back = {r.doc_id: r.text for r in decode_corpus(out).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in rows)
    assert encode_corpus(df.limit(0)).count() == 0


def test_one_scan_of_an_automaton_in_linear_time(enc, reference):
    import time

    import ahocorasick

    assert enc.auto.kind == ahocorasick.AHOCORASICK
    rng = random.Random(2)
    for alphabet in (b"a", b"ab", bytes(range(97, 123))):
        took = []
        for n in (250_000, 1_000_000):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            began = time.perf_counter()
            ids = enc.encode_bytes(data)
            took.append(time.perf_counter() - began)
            assert enc.decode(ids) == data
        assert took[1] < 12 * took[0]
    data = "ab" * 400 + "a" * 777 + "ba" * 300
    assert enc.encode_bytes(data.encode()) == reference.encode_ordinary(data)
