"""Words of many texts are hashed at once: as one by one, and in a fraction of the time that a step for each word takes."""

import random
import time

import pytest

pytest.importorskip("siglake.llm.registry")
import pyarrow as pa  # noqa: E402
import xxhash  # noqa: E402
from siglake.llm import shingles as S  # noqa: E402


@pytest.mark.parametrize("piece", [S.PIECE, 67, 200])
def test_texts_together_and_one_by_one(monkeypatch, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    rng = random.Random(1)
    texts = [None, b"", b" ", b"a", b"  A b ", b"x" * 300, b"y" * 64 + b" " + b"Z" * 65, b"q" * 500 + b" a b c d e f " + b"r" * 700 + b" "]
    texts += [bytes(rng.choice(b"aB \t\n\r\x0b\x0c\x1c\x85\xc3\xa9\xa0\x00c dd") for _ in range(rng.randrange(400))) for _ in range(200)]
    shingler = S.Shingler(4)
    want = [shingler.hashes((t or b"").lower().split()).tolist() for t in texts]
    for column in (pa.array(texts, pa.binary()), pa.array(texts, pa.large_binary())):
        assert [x.tolist() for x in shingler.each(column)] == want
    assert [x.tolist() for x in shingler.each(pa.array(texts, pa.binary()).slice(5, 50))] == want[5:55]
    for t, hashes in zip(texts, want):
        assert len(hashes) == (max(1, n - 3) if (n := len((t or b"").split())) else 0)
    same = {}
    for t, hashes in zip(texts, want):  # equal runs have equal hashes, others don't
        words = (t or b"").lower().split()
        for i, h in enumerate(hashes):
            assert same.setdefault(h, words[i : i + 4]) == words[i : i + 4]


def test_time():
    rng = random.Random(2)
    texts = [" ".join(f"{rng.randrange(10**6):x}" for _ in range(500)).encode() for _ in range(600)]
    column, spent = pa.array(texts, pa.binary()), {"words": [], "texts": []}
    for _ in range(3):
        began = time.process_time()
        for t in texts:
            for w in t.lower().split():
                xxhash.xxh3_64_intdigest(w)
        spent["words"].append(time.process_time() - began)
        began = time.process_time()
        assert sum(map(len, S.Shingler(4).each(column))) == 600 * 497
        spent["texts"].append(time.process_time() - began)
    assert min(spent["texts"]) < min(spent["words"])
