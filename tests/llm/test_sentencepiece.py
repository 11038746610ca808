import pandas as pd
import public_tokenizers
import pytest
import numpy as np

from riskweave.llm import sentencepiece as S

sp = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces.load(PATH)


def ids(row):
    return np.frombuffer(row.ids, "<i4").tolist()


def test_equals_library_on_documents(spark, pieces):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    more = ["Hello  world\n x\ty é😀", " a ", "", "ﬁ①", "    ", "<0x0A> </s> <unk>", "\n\n", "don't stop", "aaaaaaaaaaaaaaaaaaaa", "▁x y", "日本語 テキスト", "C:\\dir\\file.txt 12345.678"]
    rows = [*zip(docs.doc_id.tolist(), docs.text), *((10_000 + i, t) for i, t in enumerate(more)), (None, None), (5, "repeat"), (5, "repeat")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")
    lib = sp.SentencePieceProcessor(model_file=PATH)
    out = S.decode(S.encode(df, pieces, chunk_bytes=100_000), pieces).collect()
    assert len(out) == len(rows)
    at_once = S.encode(df, pieces, decoded=True).collect()
    assert sorted(map(str, out)) == sorted(map(str, at_once))
    for r in out:
        assert ids(r) == lib.encode(r.text or ""), r.text
        assert r.decoded == lib.decode(ids(r))


def test_unigram_equals_library(spark, tmp_path):
    """The same pieces as a unigram model; the words of one small table."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):  # distinct scores, and a sum that prefers long pieces
        if p.type == 1:
            p.score = -8.0 - (i % 977) / 250 - i / 1e6
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    lib, table = sp.SentencePieceProcessor(model_file=str(path)), S.Pieces.load(str(path))
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [*docs.text[:20], "ab" * 60 + "語x" * 50, "d" * 61, "é" * 61 + " " + "z" * 62, "one 😀 two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text: ids(r) for r in S.encode(df, table, model="unigram", chunk_bytes=10_000).collect()}
    score = lambda found: sum(lib.get_score(i) for i in found)
    for t in texts:  # of paths with equal sums the library may take another
        want = lib.encode(t)
        assert got[t] == want or lib.decode(got[t]) == t and abs(score(got[t]) - score(want)) < 1e-2, t[:50]


def test_long_words_without_spaces(spark, pieces):
    """A run of 200 kB, runs around the width of a long, and one whose every pair of letters is in a piece."""
    rng = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/")
    run = "".join(rng.choice(letters, 200_000))
    texts = [run, "語" * 70_000, "aaaaaaaaab" * 500, *("".join(rng.choice(list("inthesaro"), n)) for n in range(55, 70)), "x " + "in" * 31, "▁" * 100]
    lib = sp.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in S.encode(df, pieces).collect():
        assert ids(r) == lib.encode(r.text), r.text[:60]


def test_random_words(spark, pieces):
    rng = np.random.default_rng(8)
    lib = sp.SentencePieceProcessor(model_file=PATH)
    chars = list("etaoinshrdlu'.,-()0 19ETAÉé語\n\t$")
    texts = ["".join(rng.choice(chars, rng.integers(1, 40))) for _ in range(4_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = S.encode(df, pieces, chunk_bytes=20_000).collect()
    assert len(got) == len(texts) and all(ids(r) == lib.encode(r.text) for r in got)


def test_empty_table(spark, pieces):
    assert S.encode(spark.createDataFrame([], "doc_id long, text string"), pieces).collect() == []


def test_atoms_of_many_chunks_are_solved_once(spark, pieces, monkeypatch):
    """Words that every chunk holds go through the lattice once, not once a chunk; signs around them change nothing."""
    seen, plain = [], S.boundaries

    def counted(atoms, pieces):
        seen.append(atoms.count())
        return plain(atoms, pieces)
    monkeypatch.setattr(S, "boundaries", counted)
    words = ["alpha", "(beta)", "gamma,", "gamma", "don't\nstop", "a\0b", "x" * 90, "y" * 40]
    texts = [*[" ".join(words[i % 3:] + ["q" + chr(97 + i // 26) + chr(97 + i % 26)]) for i in range(60)], "  two  runs ", "▁ mark▁ x", "", None, "end ", "\n"]
    got = S.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces, chunk_bytes=200, decoded=True).collect()
    lib = sp.SentencePieceProcessor(model_file=PATH)
    assert len(got) == len(texts)
    for r in got:
        assert ids(r) == lib.encode(r.text or ""), r.text
        assert r.decoded == lib.decode(ids(r))
    assert seen[0] <= 60 + 40
