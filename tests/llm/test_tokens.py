import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from paneflow.llm import tokens
from paneflow.llm.queries import byte_bpe

SCHEMA = "doc_id long, text string, start string, path string"


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe())


def brute(model, rows):
    at, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def check(spark, model, rows):
    docs = spark.createDataFrame([(*r, "x", "clash") for r in rows], SCHEMA)
    got = [tuple(r) for r in tokens.tokenise(docs, byte_bpe()).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(model, rows)


def test_odd_rows(spark, model):
    texts = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n\nb c", "it's we'll", "x1 2y 33", "tab\tb", "nb\xa0sp x", "é😀 ü", "a\x01b c", "  lead", "trail  ", "<|endoftext|> x", "long word " * 30_000, "\r\n x \r y"]
    check(spark, model, [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "null id")])


def test_empty_table(spark, model):
    check(spark, model, [])


def test_documents(spark, sf_dir, model):
    check(spark, model, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_every_white_space_between_pieces(model):
    """Seeded fuzzing: 60,000 strings over all white space of Unicode and Python."""
    rng = np.random.default_rng(9)
    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace()] + ["\u200b", "\ufeff", "\u180e", "\x01"]
    signs = [*spaces, *" " * 20, *"\n" * 20, *"aB1.'" * 4, "'s", "'ll", "é", "漢", "😀", "\u0301", "<|endoftext|>"]
    encode = tokens.Encoder(byte_bpe(), 2)
    texts = ["".join(signs[i] for i in rng.integers(0, len(signs), rng.integers(1, 9))) for _ in range(60_000)]
    want = [np.array([*x.ids, 2], encode.kind).tobytes() for x in model.encode_batch(texts, add_special_tokens=False)]
    got = [ids for i in range(0, len(texts), 1000) for ids in encode(texts[i : i + 1000])]
    assert [t for t, x, y in zip(texts, want, got, strict=True) if x != y] == []


def test_memory_of_pieces_is_bounded(model, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(tokens, "SEGMENT", 500)
    encode = tokens.Encoder(byte_bpe(), 2)
    texts = [" ".join(f"w{i * j % 997}" for j in range(300)) + "x" * 200 for i in range(40)]
    for text in texts:
        assert np.frombuffer(encode([text])[0], encode.kind).tolist() == [*model.encode(text, add_special_tokens=False).ids, 2]
    assert max(map(len, encode.young)) <= tokens.SHORT
    assert len(encode.young) + len(encode.old) < 800


def test_memory_of_a_batch_is_a_small_multiple_of_its_text():
    rng = np.random.default_rng(9)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 5_000, 500)) for _ in range(1_500)], pa.large_string())
    encode = tokens.Encoder(byte_bpe(), 2)
    want = encode.arrays(texts)[0]
    tracemalloc.start()
    try:
        got = encode.arrays(texts)[0]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(got, want) and most < 16 * texts.nbytes


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, model):
        self.model, self.seen = model, 0

    def encode_batch_fast(self, texts, **more):
        self.seen += sum(map(len, texts))
        return self.model.encode_batch_fast(texts, **more)


def ids_of(encode, model, text):
    assert np.frombuffer(encode([text])[0], encode.kind).tolist() == [*model.encode(text, add_special_tokens=False).ids, 2]


def test_a_word_is_encoded_once_whatever_sign_is_behind_it(model):
    encode = tokens.Encoder(byte_bpe(), 2)
    encode.model = Counting(encode.model)
    words = [f"{chr(97 + i % 26)}word{chr(97 + i // 26)}é" for i in range(300)]
    for sign in ",.;:!?":
        ids_of(encode, model, "".join(f" {w}{sign}" for w in words))
    assert encode.model.seen < 3_000  # 2,400 characters of words


def test_frequent_pieces_outlast_batches_of_rare_ones(model, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 40_000)
    encode = tokens.Encoder(byte_bpe(), 2)
    often = " ".join(f"oft{chr(97 + i)}" for i in range(26))
    ids_of(encode, model, (often + " ") * 20)
    for k in range(5):
        ids_of(encode, model, " ".join("".join(chr(97 + (i * 7 + k * 31 + j * j) % 26) for j in range(9)) + chr(97 + i % 26) * (i // 26) for i in range(1_000)))
    encode.model = Counting(encode.model)
    ids_of(encode, model, " " + often)
    assert encode.model.seen == 0


def test_every_meeting_of_letters_digits_and_signs(model):
    """Seeded fuzzing of the cuts by kind: 60,000 strings."""
    rng = np.random.default_rng(10)
    signs = [*"abZ''09.,-_<|>", *" \n\t", "'s", "'ll", "'re", "é", "ß", "Ł", "ſ", "×", "÷", "²", "½", "¿", "́", "ƀ", "漢", "٣", "—", "’", "\x01", "\x1c", "\x7f", "\x85", "\xa0", "<|endoftext|>", "endoftext", "<|<|endoftext|>"]
    encode = tokens.Encoder(byte_bpe(), 2)
    texts = ["".join(signs[i] for i in rng.integers(0, len(signs), rng.integers(1, 9))) for _ in range(60_000)]
    want = [np.array([*x.ids, 2], encode.kind).tobytes() for x in model.encode_batch(texts, add_special_tokens=False)]
    got = [ids for i in range(0, len(texts), 1000) for ids in encode(texts[i : i + 1000])]
    assert [t for t, x, y in zip(texts, want, got, strict=True) if x != y] == []


def test_the_driver_loads_no_tokenizer(spark, model, monkeypatch):
    monkeypatch.setattr(tokens, "Encoder", None)
    check(spark, model, [(1, "a, b"), (2, None), (3, "")])
    wide = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.tokenise(spark.createDataFrame([(1, "a")], "doc_id long, text string"), byte_bpe(), end_id=70_000).collect()]
    assert wide == [(1, 2, zlib.crc32(np.array([*model.encode("a").ids, 70_000], "<u4").tobytes()))]
