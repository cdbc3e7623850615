"""Cross-tokenizer alignment against a plain two-pointer walk over the library's own tokens."""

import hashlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from gridloom.llm import queries, token_alignment
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", "  two  spaces ", "▁ mark", "tab\tand\nline", "naïve 漢字 😀 x" * 3, "<|endoftext|> <s> <0x41>", "\x00", "aaaa" * 700]


@cache
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@cache
def byte_letters():
    """The letter of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def groups_of(text):
    """Groups of (A ids, B ids); none where the tokens do not spell the text."""
    a, b = libraries()
    if not text:
        return []
    whole = (" " + text).encode()
    sides = []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    sides.append([(i, bytes(byte_letters()[c] for c in a.id_to_token(i))) for i in ids])
    found = b.encode(text)
    name = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    sides.append([(i, name(i)) for i in found])
    if any(b"".join(x for _, x in side) != whole for side in sides):
        return []
    out, at, size = [([], [])], [0, 0], [0, 0]
    while at != [len(s) for s in sides]:
        k = 0 if size[0] <= size[1] and at[0] < len(sides[0]) else 1
        i, raw = sides[k][at[k]]
        out[-1][k].append(i)
        at[k] += 1
        size[k] += len(raw)
        if size[0] == size[1]:
            out.append(([], []))
    return out[:-1]


def brute(texts):
    found = [groups_of(t) for t in texts]
    links = [Counter((i, j) for ga, gb in groups for i in ga for j in gb) for groups in found]
    count = Counter(pair for each in links for pair in each)
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    rows = []
    for groups, each in zip(found, links):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        n_a, n_b = (sum(len(g[k]) for g in groups) for k in (0, 1))
        best = sum(n for p, n in each.items() if count[p] == most[p[0]])
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        rows.append((n_a, n_b, len(groups), sum(each.values()), best, sum(n * count[p] for p, n in each.items()), digest))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("limit", [token_alignment.BROADCAST_CODES, 10], ids=["table", "join"])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(token_alignment, "BROADCAST_CODES", limit)
    given_rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("doc_id < 60").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in given_rows] + [(1000 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, "a repeated row"), (None, "a repeated row"), (1000, "same id")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, _row string")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op13_alignment(spark, str(tmp_path)).select("doc_id", *COLUMNS).collect()]
    want = [(k, *row) for (k, _), row in zip(rows, brute([t for _, t in rows]))]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_alignment(spark, str(tmp_path)).collect() == []


ENDS = st.sets(st.integers(1, 60)).map(lambda s: np.array(sorted(s), np.int64))


@given(ENDS, ENDS, st.integers(1, 9))
def test_pieces_of_any_size_find_the_common_ends(a, b, work):
    both = sorted(set(a.tolist()) & set(b.tolist()))
    at_a, at_b = token_alignment.common_ends(a, b, work)
    assert a[at_a - 1].tolist() == both and b[at_b - 1].tolist() == both
    at = np.arange(len(a) + len(b) + 1)
    merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
    assert token_alignment.diagonal(a, b, at).tolist() == [sum(k == 0 for _, k in merged[:n]) for n in at]


def test_wide_groups_are_counted_by_distinct_ids():
    table = token_alignment.byte_table([b"ab", b"b", b"a", b"aab"])
    text = pa.array(["x", "a" + "ba" * 200, ""])
    a_ids = np.array([2] + [1, 2] * 200 , np.int32)
    one = token_alignment.Tokens(a_ids, np.array([0, 0, 401, 401]), table)
    two = token_alignment.Tokens(np.array([0] * 200 + [2], np.int32), np.array([0, 0, 201, 201]), table)
    found = token_alignment.align(text, one, two)
    assert found.first.tolist() == [0, 0, 201, 201]
    wide = token_alignment.Aligned(a_ids, two.ids, np.array([0, 401]), np.array([0, 201]), np.array([0, 0, 1, 1]))
    text_at, codes, links = token_alignment.link_codes(wide, 4, 16)
    assert text_at.tolist() == [1] * 4
    assert dict(zip(codes.tolist(), links.tolist())) == {4: 200 * 200, 6: 200, 8: 201 * 200, 10: 201}
