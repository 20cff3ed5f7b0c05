"""Packing: windows against exhaustive search, pieces against the plain encoding."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curata.llm import packing, queries


def test_closest_fill_equals_exhaustive_search():
    rng = random.Random(3)
    for _ in range(300):
        counts = {}
        for _ in range(rng.randint(0, 5)):
            counts[rng.randint(1, 12)] = rng.randint(0, 4)
        room = rng.randint(0, 40)
        best = max(s for take in itertools.product(*[range(c + 1) for c in counts.values()])
                   if (s := sum(n * k for n, k in zip(counts, take))) <= room)
        chosen, total = packing.closest_fill(counts, sorted(counts), room)
        assert total == best == sum(n * k for n, k in chosen.items())
        assert all(0 < k <= counts[n] for n, k in chosen.items())


def check_pieces(pieces, texts, capacity):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in texts}
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for start, length, crc, n in sorted(own):
            assert start == at and n == len(ids[i]) and length > 0
            assert crc == zlib.crc32(np.array(ids[i][start:start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[i])
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & at - 1 == 0      # nothing is padded
    return by_seq


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(queries.QUERIES["op13_packing"](spark, sf).collect(), texts, 2048)


def test_odd_documents(spark):
    """Nulls, empty and very long texts, special strings, repeats, clashing columns, several pool rounds."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefghij ") for _ in range(20)) for _ in range(4000)) + "x" * 30_000
    texts = [(0, None), (1, ""), (2, "a <|endoftext|> b"), (3, "日本語 текст ​\x00"), (4, long)]
    texts += [(i, "word " * rng.randint(0, 90)) for i in range(5, 200)]
    df = spark.createDataFrame([(i, x, "s", 7) for i, x in texts], "doc_id int, text string, ids string, start long").repartition(3)
    ranks, specials = packing.load_byte_bpe(P.path("byte_bpe_50k.json"))
    out = packing.pack_documents(df, ranks, P.PATTERN, specials, capacity=64, pool=2000)
    assert out.schema["doc_id"].dataType.simpleString() == "int"
    check_pieces(out.withColumn("ids_crc32", F.crc32("ids")).collect(), texts, 64)


def test_repeats_null_ids_and_empty_table(spark):
    ranks, specials = packing.load_byte_bpe(P.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    out = packing.pack_documents(df, ranks, P.PATTERN, specials).collect()
    assert sum(r.length for r in out if r.doc_id is None) == 6 and sum(r.length for r in out if r.doc_id == 1) == 4
    assert packing.pack_documents(df.limit(0), ranks, P.PATTERN, specials).count() == 0


def test_windows_of_long_pieces_only_are_filled_by_cuts():
    """Lengths that leave a slack often: repeats of a choice must not outlive a cut."""
    rng = random.Random(11)
    for trial in range(60):
        capacity = 32
        pool = packing.Pool(capacity)
        docs = [rng.choice([31, 30, 29, 17, 3] if trial % 2 else [31, 20]) for _ in range(rng.randint(1, 60))]
        for d, n in enumerate(docs):
            pool.add(d, 0, np.arange(n, dtype="<u4") + 100 * d)
        windows = list(pool.windows(0))
        assert all(sum(len(ids) for *_, ids in w) == capacity for w in windows)
        windows += pool.tail()
        pieces = sorted((d, start, ids.tolist()) for w in windows for d, start, ids in w)
        assert [i for _, _, ids in pieces for i in ids] == [100 * d + i for d, n in enumerate(docs) for i in range(n)]
