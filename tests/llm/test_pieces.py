"""Tokenisers, source spans and packing."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from gridloom.llm import packing, piece_codec, queries
from gridloom.llm.tokens import ByteBpe, wide_spaces
from tokenizers import Tokenizer

PARTS = ["a", "B", "the", "  ", " ", "\n", "\r\n", "\t", "\xa0", " ", "é", "ß", "😀", "\x00", "\x1c", "▁", "<s>",
         "<|endoftext|>", "<0x41>", "中", "文", "'s", "'ll", "12", "!?", "é", "﻿", "ﬁ", "Ａ", "①", "ｶﾞ"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


TEXTS = [None, "", " ", "   ", "\n", "word " * 5000, "x" * 30000, *odd_texts(1500, 1)]


def with_normaliser(rule, **flags):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, spec = pb.ModelProto(), pb.ModelProto()
    proto.ParseFromString(queries.piece_model())
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = spec.normalizer_spec.precompiled_charsmap
    for name, value in flags.items():
        setattr(proto.normalizer_spec, name, value)
    return proto.SerializeToString()


@pytest.mark.parametrize(
    "model",
    [
        queries.piece_model(),
        with_normaliser("nmt_nfkc", remove_extra_whitespaces=True),
        with_normaliser("nfkc_cf", remove_extra_whitespaces=False, add_dummy_prefix=False),
    ],
    ids=["plain", "nmt_nfkc", "nfkc_cf"],
)
def test_ids_equal_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoded = piece_codec.PieceCodec(model).encode(pa.array(TEXTS))
    want = library.encode([t or "" for t in TEXTS], add_bos=True, add_eos=True, num_threads=1)
    got = [encoded.ids[a:b].tolist() for a, b in zip(encoded.first[:-1], encoded.first[1:])]
    assert got == want


def test_spans_tile_the_source_and_name_its_bytes():
    codec = piece_codec.PieceCodec(queries.piece_model())
    encoded = codec.encode(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        at = slice(encoded.first[i], encoded.first[i + 1])
        begin, end = encoded.begin[at].tolist(), encoded.end[at].tolist()
        assert begin[1:] == end[:-1] and (begin[0], end[-1]) == (0, len(raw))
        for piece, a, b in zip(encoded.ids[at][1:-1].tolist(), begin[1:-1], end[1:-1]):
            name = codec.whole.id_to_piece(piece)
            if not codec.whole.is_byte(piece):
                assert raw[a:b].decode().replace(" ", "▁") in (name, name[1:])


def test_spans_follow_the_character_map():
    codec = piece_codec.PieceCodec(with_normaliser("nmt_nfkc"))
    encoded = codec.encode(pa.array(["ﬁne ①"]))
    raw = "ﬁne ①".encode()
    cut = [raw[a:b].decode() for a, b in zip(encoded.begin[1:-1], encoded.end[1:-1]) if b > a]
    assert "".join(cut) == "ﬁne ①"


def test_encode_and_decode_tables(spark):
    rows = [(1, "Hello  world\n", 5), (None, None, 6), (1, "Hello  world\n", 5), (2, "", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    model = queries.piece_model()
    encoded = piece_codec.encode(table, "doc_id", "text", model)
    assert encoded.columns == ["doc_id", "ids", "begin", "end"]
    found = sorted(encoded.collect(), key=str)
    assert [r.ids for r in found if r.doc_id != 1] == [[1, 2], [1, 2]]
    texts = piece_codec.decode(encoded, "doc_id", "ids", model)
    assert sorted(r.text for r in texts.collect()) == ["", "", "Hello  world\n", "Hello  world\n"]
    assert piece_codec.encode(table.limit(0), "doc_id", "text", model).count() == 0


def test_byte_bpe_equals_the_tokenizers_file():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [e.ids for e in library.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    vocabulary = queries.byte_vocabulary()
    ids, first = ByteBpe(*vocabulary[:3]).encode(pa.array(TEXTS))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want


def test_wide_spaces_are_found_by_their_bytes():
    wide = "\x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    other = "a \n«é–’…​\u200b\u2027\u2060中。😀"
    rng = random.Random(5)
    for text in ["", wide, other, *("".join(rng.choices(wide + other, k=rng.randint(1, 40))) for _ in range(300))]:
        at = [len(text[:i].encode()) for i, c in enumerate(text) if c in wide]
        assert wide_spaces(np.frombuffer(text.encode(), np.uint8)).tolist() == at
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["".join(rng.choices(wide + other, k=rng.randint(1, 40))) for _ in range(300)]
    ids, first = ByteBpe(*queries.byte_vocabulary()[:3]).encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want


def check_packing(rows, texts, window=2048):
    """rows: (key, start, length, crc, doc_tokens, sequence, offset); texts by key, keys unique."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for key, start, length, crc, tokens, sequence, offset in rows:
        by_doc[key].append((start, length, crc, tokens))
        by_sequence[sequence].append((offset, length))
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for start, length, crc, tokens in sorted(by_doc[key]):
            piece = np.array(ids[start : start + length], "<u4")
            assert start == at and tokens == len(ids) and length > 0 and crc == crc32(piece.tobytes())
            at += length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: nothing is padded


def test_packing_covers_every_id_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3000)
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", str(i % 7)]) for _ in range(rng.randint(0, 90)))
             for i in range(200)}
    texts |= {500: None, 501: "", 502: "long " * 9000, 503: "<|endoftext|> and\xa0more"}
    table = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, start int")
    rows = [tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
            for r in queries.packed(table).collect()]
    check_packing(rows, texts)


def test_packing_cuts_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 500)
    rows = [(i % 3 or None, "one text in many copies") for i in range(600)] + [(1, None if i % 2 else "") for i in range(600)]
    rows += [(i, f"text {i} of its own") for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    shards, lengths = defaultdict(int), 0
    for r in packing.pack(table, "doc_id", "text", queries.byte_vocabulary(), 64).collect():
        shards[r.sequence_id >> 32] += 1
        lengths += r.length
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert lengths == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert max(shards.values()) < 400


def test_packing_repeated_null_and_no_rows(spark):
    table = spark.createDataFrame([(1, "same"), (1, "same"), (None, "same"), (None, None)], "doc_id long, text string")
    found = packing.pack(table, "doc_id", "text", queries.byte_vocabulary(), 8).collect()
    assert sum(r.length for r in found) == 3 * 2 + 1 and {r.doc_id for r in found} == {1, None}
    assert queries.packed(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(table, "doc_id", "text", queries.byte_vocabulary(), 1000)


def test_a_seed_is_followed_by_its_neighbours():
    cats = "whiskers purring kitten litter"
    cars = "gearbox piston exhaust chassis"
    texts = [f"{cats} one", f"{cars} two", f"{cats} three", f"{cars} four", f"{cats} five"]
    bpe = ByteBpe(*queries.byte_vocabulary()[:3])
    ids, first = bpe.encode(pa.array(texts))
    docs = [ids[a:b].astype(np.uint32) for a, b in zip(first[:-1], first[1:])]
    index = packing.Index(docs, bpe.opens_word, np.ones(packing.SLOTS, np.float32), 5.0)
    assert set(index.neighbours(0, np.array([True, False, False, False, False]))[:2]) == {2, 4}
    assert packing.fill(docs, index, 64)[0].tolist()[:3] in ([0, 2, 4], [0, 4, 2])


def test_a_seed_asks_for_further_neighbours_until_its_window_is_full():
    texts = [f"{'whiskers purring' if i % 2 else 'gearbox piston'} {i}" for i in range(300)]
    bpe = ByteBpe(*queries.byte_vocabulary()[:3])
    ids, first = bpe.encode(pa.array(texts))
    docs = [ids[a:b].astype(np.uint32) for a, b in zip(first[:-1], first[1:])]
    index = packing.Index(docs, bpe.opens_word, np.ones(packing.SLOTS, np.float32), 3.0)
    doc, _, _, sequence, _ = packing.fill(docs, index, 1024)
    in_first = doc[sequence == 0]
    assert len(in_first) > 2 * packing.NEIGHBOURS and (in_first[:150] % 2 == 0).all()
    assert sorted(set(doc.tolist())) == list(range(300))


@pytest.mark.parametrize("seed", range(4))
def test_neighbours_against_plain_bm25(seed):
    """Texts of up to 20 different words, fewer than a seed asks with, and fewer texts than it is given."""
    draw = random.Random(seed)
    texts = [" ".join(draw.choices("red blue green salt iron moon tree fish bird wolf".split(), k=draw.randint(0, 20))) for _ in range(40)]
    bpe = ByteBpe(*queries.byte_vocabulary()[:3])
    ids, first = bpe.encode(pa.array(texts))
    docs = [ids[a:b].astype(np.uint32) for a, b in zip(first[:-1], first[1:])]
    weights = np.random.default_rng(seed).random(packing.SLOTS).astype(np.float32) + 0.1
    bags = []
    for d in docs:
        cuts = [i for i in range(len(d)) if i == 0 or bpe.opens_word[d[i]]]
        bags.append([tuple(d[a:b].tolist()) for a, b in zip(cuts, [*cuts[1:], len(d)])])
    hashes, doc = packing.doc_words(np.concatenate(docs), np.append(0, np.cumsum([len(d) for d in docs])), bpe.opens_word)
    slot = {w: int(h % np.uint64(packing.SLOTS)) for w, h in zip((w for bag in bags for w in bag), hashes)}
    assert doc.tolist() == [i for i, bag in enumerate(bags) for _ in bag]
    mean = sum(map(len, bags)) / len(bags)

    def score(a, b):
        total = 0.0
        for w in set(bags[a]) & set(bags[b]):
            tf = bags[b].count(w)
            damp = packing.K1 * (1 - packing.B + packing.B * len(bags[b]) / mean)
            total += weights[slot[w]] * tf * (packing.K1 + 1) / (tf + damp)
        return total

    index = packing.Index(docs, bpe.opens_word, weights, mean)
    for a in range(len(docs)):
        used = np.zeros(len(docs), bool)
        used[[a, (a + 3) % 40]] = True
        found = index.neighbours(a, used)
        plain = {b: score(a, b) for b in range(len(docs)) if not used[b]}
        assert set(found) == {b for b, s in plain.items() if s > 0}
        ranked = [plain[b] for b in found]
        assert all(x >= y - 1e-4 for x, y in zip(ranked, ranked[1:]))


def test_digests_of_documents_against_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = queries.op1_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        want = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want
