import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from kinograph.llm.token_counts import Counter, count_tokens, load_vocabulary


def exact(vocabulary):
    t = Tokenizer(models.Unigram(list(vocabulary), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary()


def texts():
    rng = random.Random(8)
    out = ["", " ", "  ", "\n", " \n", "\n a", "a\n\nb", "a \n b", "\n<unk>\n", "a\n<unk>", "<unk>\nb", "a", " a", "a ", "a  b", "▁a", "a▁b", "<unk>", "<unk>x", "͸<unk>", "<unk><unk>", "͸͹ ͸a", "<s></s><0x41>", "\n\t x", "x" * 3000, "\U0001f9ff", "é", "\x00a"]
    letters = "abcdefghijklmnopqrstuvwxyz  \n\nABCéß中͸\U0001f600<unk>▁"
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return out


def test_public_vocabulary_counts_like_the_exact_tokenizer(vocabulary, spark):
    t, c = exact(vocabulary), Counter(vocabulary)
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts() + real:
        enc = t.encode(text, add_special_tokens=False)
        assert c.texts([text]) == [len(enc.ids)], repr(text)


def test_very_long_texts(vocabulary):
    rng = random.Random(10)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(120_000)) + "x" * 50_000
    assert list(Counter(vocabulary).texts([text, "a", text])) == [n := len(exact(vocabulary).encode(text, add_special_tokens=False).ids), 1, n]


def test_ties_follow_the_exact_tokenizer():
    rng = random.Random(9)
    for _ in range(60):
        pieces = {"<unk>": 0.0} | {f"<0x{b:02X}>": -9.0 for b in range(256)}
        for _ in range(25):
            pieces["".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4)))] = -float(rng.randint(1, 3))
        v = tuple(pieces.items())
        t, c = exact(v), Counter(v)
        for _ in range(40):
            text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 14)))
            assert c.texts([text]) == [len(t.encode(text, add_special_tokens=False).ids)], (v, text)


def test_table(spark, vocabulary):
    rows = [(1, None, 5), (2, "", 5), (None, "one two", 5), (3, "one two", 5), (3, "one two", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_tokens) for r in count_tokens(df, vocabulary).collect()), key=str)
    n = Counter(vocabulary).texts(["one two"])[0]
    assert got == sorted([(1, 0), (2, 0), (None, n), (3, n), (3, n)], key=str)
    assert count_tokens(df.limit(0), vocabulary).count() == 0
