import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import BatchEncoder, pack_bins, pack_sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_encoder_equals_tokenizer(tokenizer):
    r = random.Random(1)
    signs = "ab sSt'rvemld \n\t\r　\xa01٣²½é中́!?.'’😀‍İß<|endoftext|>\x85\x1c_"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|> x", "don't they'll we're ''s 's 'sabc '", "'", "'s", " 's", "x" * 5000]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = BatchEncoder(PATH)
    plain = BatchEncoder(PATH)
    plain.ranked = None
    for e in (encoder, plain):
        for part in range(0, len(texts), 1000):
            ids, borders = e.encode(texts[part : part + 1000])
            assert [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])] == want[part : part + 1000]


def test_swaps_empty_bins():
    # best fit leaves four bins here, three are enough
    items = np.array([6, 5, 5, 4, 4, 3, 3]) * 100
    assert sum(items) == 3000
    best_fit, searched = pack_bins(items, 1000, sweeps=0), pack_bins(items, 1000)
    assert len(searched) == 3 <= len(best_fit)
    r = np.random.default_rng(3)
    for _ in range(30):
        items = r.integers(1, 1024, r.integers(1, 400))
        bins = pack_bins(items)
        assert sorted(i for b in bins for i in b) == list(range(len(items)))
        assert all(items[b].sum() <= 1024 for b in bins)
        assert len(bins) <= len(pack_bins(items, sweeps=0))


def test_pieces_and_places(spark, tokenizer):
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoin") for _ in range(r.randint(1, 8)))
    data = [(i, " ".join(word() for _ in range(r.choice([3, 80, 300, 900]))), "x") for i in range(120)]
    data += [(500, None, None), (501, "", None), (None, "no id", None), (502, "long " * 30000, None), *[(503, "again and again", None)] * 5]
    got = pack_sequences(spark.createDataFrame(data, "doc_id long, text string, piece string"), PATH, keep_ids=True).collect()
    want = []
    for i, t, _ in data:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((g.doc_id, g.piece, g.start, g.length, zlib.crc32(g.ids)) for g in got), key=key) == sorted(want, key=key)
    places = {}
    for g in got:
        places.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(w[3] for w in want) // 1024) + 2


def test_empty_table(spark):
    assert pack_sequences(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_added_tokens_have_their_own_ids(spark, tmp_path):
    unchanged = Tokenizer.from_file(PATH)
    assert unchanged.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    r = random.Random(5)
    pieces = ["<|endoftext|>", "<|endoftext|", "|>", "a", " ", "  ", "\n", "'s", "'", "word", "é", "12", "!", "<", "<|pad|>", "<|pad|>x"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    texts += ["", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a <|endoftext|> b", " <|endoftext|>'s", "no token", "<|endoftext|>  "]
    files = [PATH]
    for name, flags in (("plain", {}), ("strips", {"lstrip": True, "rstrip": True}), ("words", {"single_word": True}), ("rounds", {"normalized": True})):
        data = json.loads(open(PATH, encoding="utf-8").read())
        base = data["added_tokens"][0]
        data["added_tokens"] += [base | {"id": 50257, "content": "<|pad|>"}, base | {"id": 50258, "content": "<|pad|>x"} | flags]
        files.append(str(tmp_path / f"{name}.json"))
        open(files[-1], "w", encoding="utf-8").write(json.dumps(data))
    for path in files:
        whole = Tokenizer.from_file(path)
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        encoder = BatchEncoder(path)
        for part in range(0, len(texts), 500):
            ids, borders = encoder.encode_all(texts[part : part + 500])
            assert [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])] == want[part : part + 500]
    rows = [(1, "a <|endoftext|> b"), (2, "x <|endoftext|> " * 900), (3, None)]
    got = {}
    for g in sorted(pack_sequences(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect(), key=lambda g: (g.doc_id, g.piece)):
        got.setdefault(g.doc_id, []).extend(np.frombuffer(g.ids, "<u4").tolist())
    assert got == {i: [*unchanged.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
