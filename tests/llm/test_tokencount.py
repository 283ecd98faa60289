import json
import random
import re
import time

import public_tokenizers
import pyarrow as pa
from tokenizers.models import WordPiece

from tessera.llm.tokencount import byte_bpe_pieces, count_pieces, piece_counts, wordpiece_pieces


def counts(texts, automaton):
    return [(int(a), int(b)) for w, p in piece_counts(pa.array(texts, pa.string()), automaton) for a, b in zip(w, p)]


def test_equals_greedy_word_pieces():
    r = random.Random(3)
    for _ in range(150):
        vocab = sorted({("##" if r.random() < 0.5 else "") + "".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 14))})
        model = WordPiece(vocab={t: i for i, t in enumerate([*vocab, "[UNK]"])}, unk_token="[UNK]", max_input_chars_per_word=10**6)
        texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 6))) for _ in range(20)]
        assert counts(texts, wordpiece_pieces(tuple(vocab))) == [(len(t.split()), sum(len(model.tokenize(w)) for w in t.split())) for t in texts]


def test_byte_vocabulary_leaves_no_word_unknown():
    a = byte_bpe_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "\x1f \x85 é中😀 unbelievable", "x" * 100000, " \t\r\n\x0b\x0c"]
    got = counts(texts, a)
    assert [w for w, _ in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    assert got[0] == (0, 0) and got[3] == (0, 0) and got[2][1] > 1000


def test_spark(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (None, "", "y")]
    got = count_pieces(spark.createDataFrame(rows, "doc_id long, text string, n_words string"), ("a", "##b", "b"))
    assert got.columns == ["doc_id", "text", "n_words", "n_pieces"]
    assert sorted((r.n_words, r.n_pieces) for r in got.collect()) == [(0, 0), (0, 0), (2, 2), (2, 2)]
    assert count_pieces(spark.createDataFrame([], "text string"), ("a",)).count() == 0


def test_byte_vocabulary_equals_greedy_matching():
    """Brute force: the longest vocabulary entry at each place, one after the other."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    a = byte_bpe_pieces(path)
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    tokens = [bytes(byte_of[c] for c in t) for t in vocab if all(c in byte_of for c in t)]
    initial = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1} | {bytes([b]) for b in range(256)}
    continuing = {t for t in tokens if t[:1] != b" "}

    def greedy(word):
        at, n, known = 0, 0, initial
        while at < len(word):
            size = next(k for k in range(min(len(word) - at, 128), 0, -1) if word[at : at + k] in known)
            at, n, known = at + size, n + 1, continuing
        return n

    r = random.Random(8)
    letters = "etaoinshrdlu ETAOIN 0123456789.,-'é中😀\n\t"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(300)]
    texts += ["the quick brown fox unbelievably internationalization " * 5, "a" * 5000 + " " + "ab" * 3000, "".join(r.choice("abcdefgh0123") for _ in range(20000))]
    want = [(len(w), sum(map(greedy, w))) for w in (re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts)]
    assert counts(texts, a) == want


def test_long_words_take_linear_time():
    a = byte_bpe_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(5)
    word = "".join(r.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/") for _ in range(1 << 21))
    begun = time.process_time()
    ((words, pieces),) = counts([word], a)
    assert words == 1 and pieces > 1 << 19 and time.process_time() - begun < 20


def test_columns_with_dots(spark):
    got = count_pieces(spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, `x.y` long"), ("a", "##b", "b"))
    assert got.columns == ["doc_id", "text", "x.y", "n_words", "n_pieces"] and got.first()[2] == 2


def test_clashing_names_of_another_case(spark):
    from tessera.llm.tokencount import count_pieces

    out = count_pieces(spark.createDataFrame([("ab abc", "x", 1)], "text string, N_WORDS string, N_Pieces int"), ("ab", "##c"))
    assert out.columns == ["text", "n_words", "n_pieces"] and tuple(out.first())[1:] == (2, 3)
