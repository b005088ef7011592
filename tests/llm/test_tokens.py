import random

import public_tokenizers
import sentencepiece

from loomwright.llm.tokens import Merger, count_tokens

from . import brute

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    m = Merger(MODEL)
    r = random.Random(3)
    for _ in range(3000):
        s = "".join(r.choice("ab  e▁\n\t<s>é中😀the.\x00ing▁▁") for _ in range(r.randint(0, 25)))
        assert m.count(s) == len(sp.encode(s)), s
    rows = brute.corpus(6) + [(80_000, "x" * 5000, None, None, 0), (80_001, "<s> </s> <unk> <0x0A>", None, None, 0)]
    got = count_tokens(spark.createDataFrame(rows, brute.SCHEMA), MODEL).collect()
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, *_ in rows]
    assert brute.order(got) == brute.order(want)
    assert count_tokens(spark.createDataFrame([], brute.SCHEMA), MODEL).count() == 0


def test_odd_rows_and_clashing_names(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(None, None, 1, 2, True), (1, "", 1, 2, True), (2, long, 1, 2, True), (2, long, 1, 2, True)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int, n_bytes int, over_limit boolean")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs, MODEL).collect())
    n = len(sp.encode(long))
    assert got == [(0, 0, 0, False), (1, 0, 0, False), (2, len(long), n, True), (2, len(long), n, True)]
