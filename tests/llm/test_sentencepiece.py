import random

import numpy as np
import pytest
import sentencepiece as library
from sentencepiece import sentencepiece_model_pb2 as proto

from tablesteps.llm import sentencepiece as S
from tablesteps.llm.queries import PIECE_MODEL

from .helpers import corpus, docs, odd_docs


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces as a unigram model; scores that float32 sums keep exact."""
    model = proto.ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = (p.score if p.score > -1e6 else -40000.0 - len(p.piece)) / 64
    path = tmp_path_factory.mktemp("pieces") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def texts(pieces):
    rng = random.Random(7)
    odd = [" ", "  ", "\n", "\t", "a", "日本", "é", "𝔘", "the", "\x00", "▁", "’", "word", " " * 37]
    out = ["", " ", "   ", " a", "a ", "\n", "a\n b", "x" * 900, "ab" * 400, "the " * 50]
    for _ in range(400):
        out.append("".join(rng.choice([rng.choice(pieces), rng.choice(odd)]) for _ in range(rng.randint(1, 12))))
    out += ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 300))) for _ in range(100)]
    return out + [t for _, t in corpus(9) if t]


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_ids_are_the_librarys(kind, unigram):
    path = PIECE_MODEL if kind == "bpe" else unigram
    model = S.Pieces(path)
    own, peer = S.Encoder(model), library.SentencePieceProcessor(model_file=path)
    cases = texts(list(model.ids))
    for some in (cases[:200], cases[200:]):
        got = own.encode([t.encode() for t in some])
        for text, ids in zip(some, got):
            assert ids.tolist() == peer.encode(text), text
            assert S.decode_ids(ids, model.raw) == text.replace("▁", " ") == peer.decode(ids.tolist()).replace("▁", " ")


def test_batch_walk_equals_single_walk(unigram):
    for path in (PIECE_MODEL, unigram):
        model = S.Pieces(path)
        own = S.Encoder(model)
        rng = random.Random(3)
        words = ["▁" + "".join(rng.choice("aehinorst") for _ in range(9)) for _ in range(200)]
        rows = own._walk(np.array([[model.char[ord(c)] for c in w] for w in words]))
        assert [[i for i in r if i >= 0] for r in rows.tolist()] == [own._walk_one(w) for w in words]


def test_forgetting_changes_nothing(monkeypatch):
    model = S.Pieces(PIECE_MODEL)
    cases = [t.encode() for t in texts(list(model.ids))]
    whole = [x.tolist() for x in S.Encoder(model).encode(cases)]
    monkeypatch.setattr(S, "KNOWN_WORDS", 20)
    monkeypatch.setattr(S, "PAIR_SLOTS", 1 << 20)
    small = S.Encoder(model)
    assert [small.encode([t])[0].tolist() for t in cases] == whole


def test_dataframes(spark):
    rows = [(1, "Hello  wörld\n"), (2, None), (3, ""), (1, "Hello  wörld\n"), (4, "a" * 5000)]
    df = odd_docs(spark, rows)
    coded = S.encode(df, PIECE_MODEL, df.columns)
    assert coded.columns == [*df.columns, "piece_ids"]
    back = {r["a.b"]: (r.doc_id, r.piece_ids, r.decoded) for r in S.decode(coded, PIECE_MODEL, coded.columns).collect()}
    peer = library.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert back == {i: (d, peer.encode(t or ""), t or "") for i, (d, t) in enumerate(rows)}
    both = S.encode_and_decode(df, PIECE_MODEL, ["a.b"]).collect()
    assert {r["a.b"]: (r.piece_ids, r.decoded) for r in both} == {k: v[1:] for k, v in back.items()}
    assert S.encode_and_decode(docs(spark, []), PIECE_MODEL, ["doc_id"]).collect() == []
    none = spark.createDataFrame([(1, None)], "i int, piece_ids array<int>")
    assert [r.decoded for r in S.decode(none, PIECE_MODEL, ["i"]).collect()] == [""]
