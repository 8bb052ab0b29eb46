import base64
import random
from pathlib import Path

import pytest

from engramlake.llm import tokens

CONFIG = tokens.TokenizerConfig()
pytestmark = pytest.mark.skipif(not Path(CONFIG.ranks_path).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(CONFIG.ranks_path, "rb"))}
    return tiktoken.Encoding("whole", pat_str=CONFIG.pattern, mergeable_ranks=ranks, special_tokens={})


def test_fragments_give_the_ids_of_whole_texts(plain):
    enc = tokens.encoder(Path(CONFIG.ranks_path).read_bytes(), CONFIG)
    rng = random.Random(1)
    bits = ["a", "word", " the", "  ", "\n", "\t", "'s", "'", "’s", "é", "ü", "中文", "字", " ", " ", "　", "​", "😀", "👩‍👧", "123", "4", "!", "...", "<|endoftext|>", "\r\n", "'LL", "ÃŸ", "\x00", "́", "﻿", "=", "(", ")"]
    for n in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))
        assert enc.encode(t) == plain.encode_ordinary(t), repr(t)


def test_cuts_are_made():
    enc = tokens.encoder(Path(CONFIG.ranks_path).read_bytes(), CONFIG)
    assert len(enc.cuts(b"one two  three, four")) >= 3


def test_null_empty_long_and_clashing_columns(spark, plain):
    long = "lorem ipsum dolor " * 60_000 + "x" * 300_000
    rows = [(1, None, "a"), (2, "", "b"), (3, "   ", "c"), (4, long, "d"), (4, "hi", "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {(r.doc_id, len(r.ids)): r.ids for r in tokens.encode_corpus(df).collect()}
    assert got[1, 0] == [] and got[2, 0] == []
    assert [v for (k, _), v in got.items() if k == 3] == [plain.encode_ordinary("   ")]
    assert plain.encode_ordinary(long) in [v for (k, _), v in got.items() if k == 4]
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    n = {(r.doc_id, r.n_tokens) for r in tokens.count_tokens(df).collect()}
    assert (1, 0) in n and (4, len(plain.encode_ordinary("hi"))) in n
