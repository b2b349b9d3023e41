import random
import time

import pytest
from pyspark.sql import functions as F

from riskloom.llm.encoding import PATTERN, Encoder, Merges, encode_text, read_ranks
from riskloom.llm.queries import TOKENIZERS

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    ranks = read_ranks(RANKS)
    own = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return Encoder(Merges(ranks)), tiktoken.Encoding("own", pat_str=own, mergeable_ranks=ranks, special_tokens={})


def test_equals_public_library_on_hard_texts(pair):
    ours, theirs = pair
    rng = random.Random(5)
    texts = ["a" * n for n in (1, 2, 3, 255, 256, 257, 4000)]
    texts += ["".join(rng.choice("abc de\n\t　é日本\x1c\x85 'sS!?.0𝔘") for _ in range(n)) for n in [5, 60, 900] * 40]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (300, 3000)]
    texts += ["=-" * 2000, "<|endoftext|> x", " \n\n  a", "we'll can't", "🧪👩‍💻"]
    assert ours.encode(texts) == [theirs.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_long_pieces_equal_public_library(pair, seed):
    ours, theirs = pair
    rng = random.Random(seed)
    letters = ["ab", "abc", "abcdefghijklmnopqrstuvwxyz", "etaoinshrdlu", "日本語の文章を書く", "=-", "аеиостнр", "éèà"][seed:] + ["ก่ขคงจ", "0123456789"]
    texts = ["".join(rng.choice(x) for _ in range(n)) for x in letters for n in (255, 256, 257, 700, 5000)]
    texts += ["the" * 900, "ab" * 3000 + "c", "internationalization" * 300, " " * rng.randint(300, 5000), "\n" * rng.randint(300, 3000), "=" * rng.randint(300, 9000), "a" * rng.randint(300, 9000)]
    assert ours.encode(texts) == [theirs.encode_ordinary(t) for t in texts]


def test_work_grows_with_the_piece(pair):
    rng = random.Random(3)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "a" * 200_000, " " * 200_000, "日本語の文章" * 20_000):
        began = time.time()
        ids = pair[0].encode([text])[0]
        assert time.time() - began < 20 and pair[1].decode(ids) == text


def test_null_empty_repeated_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " ", None), (3, " ", None), (4, "word " * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = df.select("doc_id", encode_text(spark, F.col("text"), RANKS).alias("ids")).collect()
    got = {r.doc_id: r.ids for r in out}
    assert len(out) == 5 and got[1] == [] and got[2] == [] and got[3] == [220] and len(got[4]) == 5001
    assert df.limit(0).select(encode_text(spark, F.col("text"), RANKS)).count() == 0


def test_decodes_to_the_text(pair):
    ours = pair[0]
    back = {i: b for b, i in read_ranks(RANKS).items()}
    for text in ["Größe 12,5 – naïve", "分层规则 失败", "मि.से.\r\n\t"]:
        assert b"".join(back[i] for i in ours.encode([text])[0]).decode() == text
    assert PATTERN
