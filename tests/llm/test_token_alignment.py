"""Alignment of two tokenisations against a plain merge per document."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curata.llm import packing, queries, token_alignment as T
from curata.session import checkpointed

SYMBOLS = packing.byte_symbols()


def plain(texts):
    """{row: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)} straight from the definition."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    links, groups, sizes = {}, {}, {}
    for k, text in enumerate(texts):
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        words_a = [bytes(SYMBOLS[c] for c in t.id_to_token(i)) for i in a]
        words_b = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, s.id_to_piece(b))] if b else []
        raw = (" " + text).encode() if text else b""
        if not text or b"".join(words_a) != raw or b"".join(words_b) != raw:
            a, b, words_a, words_b = [], [], [], []
        span = lambda words: [(sum(map(len, words[:i])), sum(map(len, words[:i + 1]))) for i in range(len(words))]
        at_a, at_b = span(words_a), span(words_b)
        links[k] = [(x, y) for x, (s0, e0) in zip(a, at_a) for y, (s1, e1) in zip(b, at_b) if s0 < e1 and s1 < e0]
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        inside = lambda ids, at, lo, hi: ",".join(str(i) for i, (_, e) in zip(ids, at) if lo < e <= hi)
        groups[k] = ";".join(inside(a, at_a, lo, hi) + "|" + inside(b, at_b, lo, hi) for lo, hi in zip([0, *cuts], cuts))
        sizes[k] = len(a), len(b), len(cuts)
    count = Counter(x for own in links.values() for x in own)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return {k: (*sizes[k], len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own),
                hashlib.sha256(groups[k].encode()).hexdigest() if sizes[k][0] else "") for k, own in links.items()}


def rng_texts():
    rng = random.Random(9)
    odd = [None, "", " ", "a", "  two  spaces ", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 текст ελ", "a▁b", "tab\tnew\nline", "😀🏽 é́", "x\x00y", "x" * 700, "word"]
    return odd + ["".join(rng.choice("abcdeé ñ,\n") for _ in range(rng.randint(1, 300))) for _ in range(20)] + ["word", "word"]


def scored(df, head=T.HEAD):
    ranks, _ = packing.load_byte_bpe(P.path("byte_bpe_50k.json"))
    aligned = T.align_documents(df, ranks, P.PATTERN, open(P.path("piece_bpe_32k.model"), "rb").read())
    kept = checkpointed(aligned.withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups"))
    return T.with_scores(kept, head)


@pytest.mark.parametrize("head", [T.HEAD, 40])
def test_equals_the_definition(spark, monkeypatch, head):
    texts = rng_texts()
    df = spark.createDataFrame([(i, x, "other", 3) for i, x in enumerate(texts)], "doc_id long, text string, pairs string, n_a int").repartition(2)
    found = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.sha) for r in scored(df, head).collect()}
    assert found == plain([x or "" for x in texts])


def test_lanes_of_any_length_give_the_same_links():
    rng = np.random.default_rng(1)
    for _ in range(50):
        total = int(rng.integers(1, 60))
        ends = [np.union1d(rng.integers(1, total + 1, rng.integers(0, total + 1)), [total]) for _ in range(2)]
        size_b = np.diff(np.concatenate(([0], ends[1])))
        first_b = np.array([0, len(ends[1])])
        plain_links = sorted((i, j) for i in range(len(ends[0])) for j in range(len(ends[1]))
                             if (ends[0][i - 1] if i else 0) < ends[1][j] and (ends[1][j - 1] if j else 0) < ends[0][i])
        for lane in (1, 3, 1000):
            a, b, cuts_a, cuts_b = T.lockstep(ends[0], ends[1], size_b, first_b, lane)
            assert sorted(zip(a, b)) == plain_links
            assert sorted(ends[0][cuts_a]) == sorted(ends[1][cuts_b]) == sorted(set(ends[0]) & set(ends[1]))


def test_query_on_the_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text or "" for r in rows}
    found = {r.doc_id: r for r in queries.QUERIES["op12_token_alignment"](spark, sf).collect()}
    assert found.keys() == short.keys() and len(found) == len(rows)
    keys = [k for k in short if len(short[k]) < 1500]                        # the plain version takes the square of a text's length
    want = plain([short[k] for k in keys])
    for i, k in enumerate(keys):
        r = found[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*want[i][:4], want[i][6])
        assert r.n_best <= r.n_links <= r.count_sum


def test_repeats_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "word"), (None, "word"), (1, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_links, r.count_sum) for r in scored(df).collect()), key=str)
    assert rows[0] == (1, 0, 0) and rows[1] == rows[2] == (None, 1, 2)
    assert scored(df.limit(0)).count() == 0
