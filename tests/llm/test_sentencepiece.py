import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from catalink.llm.sentencepiece_codec import CharacterMap, Codec, Model, decode_column, encode_texts
from tests.llm.helpers import clashing, docs

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", " a", "a ", "▁", "▁▁x", "  hello   world \n\t x", "日本語テキスト", "😀😀 x", "\u0000a", "�", "x" * 5000, "é̂" * 300,
    "<s> </s> <unk> <0x0A>", "   " * 50 + "k", "don't 123 45.6", "a \nb\n\nc\n", "\nThe", "the of and " * 3000,
]


def random_texts(n):
    draw = random.Random(5)
    return ["".join(draw.choice("ab ▁é漢😀\n1!Tthe ") for _ in range(draw.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return Codec(Model.load(PATH))


def test_ids_spans_and_decoding_equal_the_library(library, codec):
    texts = ODD + random_texts(1500)
    for text, (ids, borders) in zip(texts, codec.encode_all([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(text), repr(text[:50])
        assert codec.decode(ids.tolist()) == library.decode(ids.tolist())
        pieces = library.encode(text, return_type="proto").pieces
        assert [(borders[i], borders[i + 1]) for i in range(len(ids))] == [(p.begin, p.end) for p in pieces], repr(text[:50])


def test_a_text_has_the_same_ids_alone(codec):
    texts = [t.encode() for t in random_texts(200)]
    for text, (ids, _) in zip(texts, codec.encode_all(texts)):
        assert Codec(codec.model).encode(text)[0].tolist() == ids.tolist() if len(text) < 12 else True


def test_any_ids_decode_as_in_the_library(library, codec):
    draw = random.Random(3)
    for _ in range(500):
        ids = [draw.choice([0, 1, 2, 29871, draw.randint(0, 300), draw.randint(0, 31999)]) for _ in range(draw.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def charmap(entries):
    """A compiled character map of these replacements: a double array by first fit, and its texts."""
    texts, places = b"", {}
    for value in entries.values():
        places.setdefault(value, len(texts))
        texts += value + b"\0"
    trie = {}
    for key in entries:
        node = trie
        for byte in key:
            node = node.setdefault(byte, {})
        node[-1] = places[entries[key]]
    units, used = {0: 0}, {0}

    def put(node, at):
        labels = [b for b in node if b >= 0]
        base = next(b for b in range(1, 1 << 20) if all((b ^ x) not in used for x in [*labels, *([0] if -1 in node else [])]))
        offset = at ^ base
        assert offset < 1 << 21
        units[at] = units.get(at, 0) | offset << 10 | (-1 in node) << 8
        taken = {base ^ x for x in labels} | ({base} if -1 in node else set())
        used.update(taken)
        if -1 in node:
            units[base] = node[-1] | 1 << 31
        for x in labels:
            units[base ^ x] = x
        for x in labels:
            put(node[x], base ^ x)

    put(trie, 0)
    size = (max(units) // 256 + 1) * 256  # the library wants whole blocks
    blob = b"".join(struct.pack("<I", units.get(i, 0)) for i in range(size))
    return struct.pack("<I", len(blob)) + blob + texts


def test_character_map_finds_the_longest_prefix():
    entries = {"ﬁ".encode(): b"fi", b"A": b"a", b"AB": b"xyz", "　".encode(): b" ", b"\t": b" "}
    found = CharacterMap(charmap(entries))
    assert found.longest(b"ABC", 0) == (b"xyz", 2)
    assert found.longest(b"AC", 0) == (b"a", 1)
    assert found.longest(b"C", 0) is None
    assert found.longest("xﬁ".encode(), 1) == (b"fi", 3)


def test_a_mapped_and_squeezed_text_equals_the_library(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    entries = {"ﬁ".encode(): b"fi", b"A": b"a", b"AB": b"xyz", "　".encode(): b" ", b"\t": b" ", b"\n": b" ", b"Q": b""}
    proto.normalizer_spec.precompiled_charsmap = charmap(entries)
    proto.normalizer_spec.name = "own"
    proto.normalizer_spec.remove_extra_whitespaces = True
    own = Codec(Model.load(_written(proto, tmp_path)))
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "own.model"))
    draw = random.Random(9)
    texts = ["", "  ", "ABBA ﬁn", "\t\tA　 B Q"] + ["".join(draw.choice("ABQ ﬁ　\t\nthe▁é") for _ in range(draw.randint(0, 30))) for _ in range(500)]
    for text in texts:
        ids, borders = own.encode(text.encode())
        assert ids.tolist() == library.encode(text), repr(text)
        assert own.decode(ids.tolist()) == library.decode(ids.tolist()), repr(text)
        pieces = library.encode(text, return_type="proto").pieces
        assert [(borders[i], borders[i + 1]) for i in range(len(ids))] == [(p.begin, p.end) for p in pieces], repr(text)


def _written(proto, folder):
    path = folder / "own.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_rows_nulls_and_repeats(spark, library):
    texts = [None, "", "the same", "the same", "x" * 200_000, *ODD]
    df = clashing(docs(spark, texts))
    encoded = encode_texts(df, PATH, parts=("ids", "borders", "n_ids", "n_bytes", "decoded"))
    found = {r["doc_id"]: r for r in encoded.withColumn("back", decode_column(spark, PATH, F.col("encoding.ids"))).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        e, want = found[i]["encoding"], library.encode(text or "")
        assert e["ids"] == want and e["n_ids"] == len(want)
        assert len(e["borders"]) == len(want) + 1 and e["borders"] == sorted(e["borders"])
        assert e["n_bytes"] == len((text or "").encode()) if want else e["n_bytes"] == 0
        assert found[i]["back"] == library.decode(want) == e["decoded"]
    assert encode_texts(df.limit(0), PATH).count() == 0


def test_borders_are_whole_numbers(codec):
    assert codec.encode(b"")[1].dtype == np.int64 and codec.encode(b"ab")[1].dtype == np.int64
