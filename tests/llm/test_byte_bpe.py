import base64
import hashlib
import random
import struct

import pytest

from quarry.llm import byte_bpe as B

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


def brute(piece, ids):
    """Merge the leftmost pair of least rank until none is left."""
    if piece in ids:
        return [ids[piece]]
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, k = min((ids.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 30:
            break
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return [ids[p] for p in parts]


def unpack(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def odd_texts(rng):
    alphabet = ["the", "ing", "a", "e", "Ä", "ß", "漢", "字", "🙂", " ", "  ", "\n", "\t", "\x00", "'s", "'ll", "1", "99", "#", "--", " ", "́"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += ["", " ", "a", "x" * 5000, "ab" * 999, " " * 700, "e" * 257, "<|endoftext|>", "'s't're", "漢" * 300, "".join(map(chr, range(1, 0x3000)))]
    return texts + texts[:5]


def test_trees_match_brute_force(ranks):
    rng = random.Random(1)
    pieces = {"".join(rng.choice("abcdefghiätz") for _ in range(rng.randint(1, 140))) for _ in range(800)}
    pieces |= {"aaaa", "ab" * 64, "zz", "a" * 128, "a" * 129, "e" * 400}
    got = B.merge_pieces(sorted(pieces), ranks)
    assert {p: unpack(v) for p, v in got.items()} == {p: brute(p.encode(), ranks.ids) for p in pieces}
    for p in sorted(pieces)[:200]:
        raw = p.encode()
        if raw not in ranks.ids:
            assert unpack(B.merge_one(raw, ranks)) == brute(raw, ranks.ids)


def test_equal_ranks_go_left_to_right():
    ids = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aab": 257, b"ba": 258}
    own = B.make_ranks(ids)
    for p in ("aaa", "aaaa", "aaab", "aabaa", "baaab", "baba"):
        assert unpack(B.merge_pieces([p], own)[p]) == brute(p.encode(), ids)
    with pytest.raises(ValueError):
        B.make_ranks({b"a": 0})


@pytest.mark.parametrize("stretch,kept", [(1 << 20, 200_000), (7, 3)])
def test_texts_match_the_library(ranks, library, monkeypatch, stretch, kept):
    monkeypatch.setattr(B, "STRETCH", stretch)
    monkeypatch.setattr(B, "KEPT", kept)
    texts = odd_texts(random.Random(2))
    coder = B.Coder(ranks, P.PATTERN)
    packed = coder.encode(texts)
    assert [unpack(p) for p in packed] == [library.encode_ordinary(t) for t in texts]
    assert [coder.decode(p).decode() for p in packed] == texts


def test_tables_and_round_trip(spark, library):
    texts = odd_texts(random.Random(3))
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, None, "x"), (5, "again", "x"), (5, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string").repartition(5)
    got = B.byte_bpe(df, PATH, P.PATTERN, with_ids=True, with_decoded=True)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]

    def want(i, t):
        ids = library.encode_ordinary(t or "")
        return (str(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids))
    have = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got.collect())
    assert have == sorted(want(i, t) for i, t, _ in rows)
    again = B.decode(got.select("doc_id", "ids", "decoded"), PATH)
    assert again.columns == ["doc_id", "ids", "decoded"]
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert B.byte_bpe(df.filter("false"), PATH, P.PATTERN).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in B.decode(nothing, PATH).collect()] == [b"", b""]


def test_rank_file_limits(tmp_path):
    f = tmp_path / "r.tiktoken"
    f.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)))
    assert unpack(B.Coder(B.read_ranks(str(f)), P.PATTERN).encode(["hé"])[0]) == list("hé".encode())
    with pytest.raises(ValueError):
        B.read_ranks(str(f), max_file=10)


def test_query_matches_the_library(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in B.op11_byte_bpe(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
