import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewright.llm import wavelet
from lakewright.llm.queries import tokenizer_path
from lakewright.llm.wavelet import Encoder, WaveletMatrix
from lakewright.sources.tables import table


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected_rows(tokenizer, rows):
    out, start = [], 0
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t 　\x85\0.!'s1<|", max_size=30), min_size=1, max_size=6))
def test_pieces_are_exact(texts):
    encoder = test_pieces_are_exact.__dict__.setdefault("encoder", Encoder(tokenizer_path()))
    ids, sizes = encoder.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for text, n, end in zip(texts, sizes, ends):
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[end - n : end].tolist() == [*whole, 0]


def test_encoder_forgets(monkeypatch, tokenizer):
    monkeypatch.setattr(wavelet, "CACHE", 20)
    encoder = Encoder(tokenizer_path())
    for i in range(8):
        texts = [f"common word{i} other{i} common common more{j}{i}" for j in range(5)] + [None, "<|endoftext|> x  "]
        ids, sizes = encoder.encode(pa.array(texts))
        whole = [x for t in texts for x in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]]
        assert ids.tolist() == whole and sizes.sum() == len(whole)


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (700, 2), (5000, 60000), (300000, 50256)])
def test_matrix_reads(n, top):
    ids = np.random.default_rng(n).integers(0, top, n) if n else np.zeros(0, np.int64)
    matrix = WaveletMatrix(WaveletMatrix.build(ids, [1, None], np.array([n, 0]), 3))
    for i in {0, n // 3, n - 1} if n else set():
        token = int(ids[i])
        assert matrix.access(i) == token
        assert matrix.count(token) == (ids == token).sum()
        assert matrix.count(token, n // 4, n // 2) == (ids[n // 4 : n // 2] == token).sum()
        first = [p for p, _ in zip(matrix.locate(token), range(3))]
        assert first == np.flatnonzero(ids == token)[:3].tolist()
    assert matrix.count(70001) == 0
    assert matrix.decode().tolist() == ids.tolist()
    assert matrix.documents()[0] == [1, None]
    with pytest.raises(ValueError):
        WaveletMatrix(b"nothing of this kind")


def test_documents(spark, folder, tokenizer):
    docs = table(spark, folder, "documents")
    read = wavelet.read_shards(spark, wavelet.write_shards(docs, tokenizer_path(), shard_bytes=50_000))
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in read.collect()) == expected_rows(tokenizer, rows)


def test_hard_rows(spark, tokenizer):
    rows = [(5, "b"), (None, "n"), (5, "a"), (2, None), (2, ""), (9, "word " * 40000), (7, "x"), (7, "x")]
    read = wavelet.read_shards(spark, wavelet.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()))
    order = [(None, "n"), (2, None), (2, ""), (5, "a"), (5, "b"), (7, "x"), (7, "x"), (9, "word " * 40000)]
    assert sorted((tuple(r) for r in read.collect()), key=lambda r: r[1]) == expected_rows(tokenizer, order)
    none = spark.createDataFrame([], "doc_id long, text string, shard string")
    assert wavelet.read_shards(spark, wavelet.write_shards(none, tokenizer_path())).count() == 0


def test_a_known_word_before_marks(tokenizer):
    encoder = Encoder(tokenizer_path())
    texts = ["word other Word thing don", "word, other... Word!? thing; don't: don. wor.d other.", "other.,;:!? x. other.\nnew"]
    for text in texts:
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert encoder.marks


def test_rows_without_id_fill_many_shards(spark, tokenizer):
    rows = [(None if i % 3 == 0 else i, f"text {i * 7919 % 600} of " + "words " * 60) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = wavelet.write_shards(docs, tokenizer_path(), shard_bytes=10_000)
    sizes = [len(WaveletMatrix(f.content).documents()[0]) for f in spark.read.format("binaryFile").load(folder).select("content").collect()]
    assert len(sizes) > 15 and max(sizes) < 100
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted((tuple(r) for r in wavelet.read_shards(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected_rows(tokenizer, order)


def check_texts(encoder, tokenizer, texts):
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    whole = [[*e.ids, 0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, whole))
    assert ids.tolist() == [i for part in whole for i in part]


def test_every_character_between_others(tokenizer):
    encoder = Encoder(tokenizer_path())
    points = [*range(0x3100), *range(0xA000, 0xA100), *range(0xF900, 0x10000), *range(0x1F300, 0x1F700), 0x1D400, 0xE0001]
    for a in range(0, len(points), 4000):
        chars = list(map(chr, points[a : a + 4000]))
        check_texts(encoder, tokenizer, [f"w{c} a{c}{c}.{c}1{c}\n{c}'s{c}b {c}é{c}я" for c in chars])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abst é×я中́ \n\t\r\x0b\x1f\x7f'’.,(0²<", max_size=40), min_size=1, max_size=6))
def test_cuts_are_ends_of_tokens(texts):
    encoder = test_cuts_are_ends_of_tokens.__dict__.setdefault("encoder", Encoder(tokenizer_path()))
    check_texts(encoder, encoder.tokenizer, texts)


def test_known_words_beside_any_signs_are_not_encoded_again(tokenizer, monkeypatch):
    encoder = Encoder(tokenizer_path())
    check_texts(encoder, tokenizer, ["Onté. Word (1) a\n other's"])
    asked = []
    add = encoder._add
    monkeypatch.setattr(encoder, "_add", lambda pieces: (asked.extend(pieces.to_pylist()), add(pieces)))
    check_texts(encoder, tokenizer, ["Onté.\nOnté(1 Word. Word) Onté Word\n\n", None, ""])
    assert sorted(asked) == ["\n", "\n\n", " Onté", "("]


def test_added_tokens_and_long_texts_are_not_kept(tokenizer, monkeypatch):
    monkeypatch.setattr(wavelet, "CACHE", 50)
    encoder = Encoder(tokenizer_path())
    for i in range(4):
        check_texts(encoder, tokenizer, [f"a{i} <|endoftext|> " + "b c" * 4000] * 2 + ["x" * 9000, "<|endoftext|>", None, " <|endoftext|"])
    encoder.encode(pa.array([None], pa.string()))
    assert encoder.known.nbytes < 10_000
    check_texts(encoder, tokenizer, [None, ""])


def test_an_added_token_of_letters_and_another_cutter(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    made = Tokenizer.from_file(tokenizer_path())
    made.add_tokens(["stop"])
    made.save(str(tmp_path / "added.json"))
    texts = ["a stop", "stop", "nonstop. other words", "stops", "words other"]
    check_texts(Encoder(str(tmp_path / "added.json")), made, texts)
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)
    made.save(str(tmp_path / "other.json"))
    check_texts(Encoder(str(tmp_path / "other.json")), made, texts)
