"""SentencePiece pieces and spans against the library, with the model's own character map and with a real one."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from rivulet.llm import piece_codec
from rivulet.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "  a  b ", "hello world\nfoo\n\n bar \n", "▁x ▁▁", "\0a\0 b", "<s> </s> <unk> <0x41>", "日本語テスト 𝒳 é é", " " * 300, "\n" * 50 + "\t\t a", "ﬁ ＡＢＣ①  ㌔ ", "x" * 3000]


def texts(n=250):
    rng = random.Random(3)
    some = "ab cdeé\n\t ▁日𝒳ﬁＡ<s>  .,́　​"
    return ODD + ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(n)]


def model(spec=None, byte_fallback=True, **flags):
    with open(PATH, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    if spec:
        proto.normalizer_spec.CopyFrom(sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=spec).serialized_model_proto()).normalizer_spec)
    for name, value in flags.items():
        setattr(proto.normalizer_spec, name, value)
    if not byte_fallback:
        proto.trainer_spec.byte_fallback = False
        for p in proto.pieces:
            if p.type == 6:
                p.type, p.piece = 1, "never" + p.piece
    return proto.SerializeToString()


def same_as_library(blob, rows):
    codec = piece_codec.Codec(blob)
    rows = [t or "" for t in rows]
    counts, ids, begins, ends = codec.encode(rows)
    upto = np.concatenate([[0], np.cumsum(counts)])
    for text, i, j in zip(rows, upto[:-1], upto[1:], strict=True):
        assert ids[i:j].tolist() == codec.library.encode(text), text
        wanted = [(p.begin, p.end) for p in codec.library.encode(text, return_type="proto").pieces]
        assert list(zip(begins[i:j].tolist(), ends[i:j].tolist(), strict=True)) == wanted, text


def test_ids_and_spans():
    same_as_library(model(), texts(2000))


@pytest.mark.parametrize("spec,dummy,squeeze", [("nmt_nfkc", True, True), ("nmt_nfkc", False, False), ("nfkc_cf", True, False)])
def test_with_a_character_map(spec, dummy, squeeze):
    same_as_library(model(spec, add_dummy_prefix=dummy, remove_extra_whitespaces=squeeze, escape_whitespaces=True), texts())


def test_without_byte_pieces():
    same_as_library(model("nmt_nfkc", byte_fallback=False, add_dummy_prefix=True, remove_extra_whitespaces=True), texts())


def test_small_tables_and_sections(monkeypatch):
    monkeypatch.setattr(piece_codec, "ROOM", 3000)
    monkeypatch.setattr(piece_codec, "SECTION", 40)
    same_as_library(model(), texts(300))


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model())
        proto.pieces[500].type = 4
        piece_codec.Codec(proto.SerializeToString())


def test_on_spark(spark, tmp_path):
    rows = [(i, t, "x", 5) for i, t in enumerate(texts(100))] + [(None, "a b", "y", 1), (3, "a", "z", 2), (3, "a", "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = piece_codec.decode(piece_codec.encode(docs, PATH), PATH).collect()
    wanted = sorted(((d, library.encode(t or "")) for d, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == wanted
    assert all(r.decoded == library.decode(r.ids) and r.n_tokens == len(r.ids) == len(r.begins) for r in got)
    same = piece_codec.encode(docs, PATH, decoded=True).collect()
    assert sorted(map(str, same)) == sorted(map(str, got))
    assert piece_codec.encode(docs.limit(0), PATH).collect() == []
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op11_sentencepiece_codec"](spark, str(tmp_path)).count() == len(rows)
