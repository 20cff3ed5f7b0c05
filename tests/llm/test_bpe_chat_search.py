"""Byte-level BPE, chat formatting and top-k search against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from curata.llm import byte_bpe, chat_format, vector_search
from curata.llm.queries import QUERIES, bpe_digests

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_bpe_is_what_tiktoken_says(spark):
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(7)
    texts = [None, "", " ", "Hello, world! <|endoftext|>", "naïve ñandú 漢字 \U0001F600", "a" * 5000, "ab" * 4000, "\n\n  \t x",
             "".join(rnd.choice("abcdefgh") for _ in range(3000)), " ".join("".join(rnd.choice("etaoinéß") for _ in range(rnd.randrange(1, 12))) for _ in range(4000))]
    rows = [*enumerate(texts), (3, texts[3]), (None, "x y")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int")
    found = sorted(map(tuple, bpe_digests(docs).collect()), key=str)
    ids = [(i, t or "", plain.encode_ordinary(t or "")) for i, t in rows]
    assert found == sorted(((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t, x in ids), key=str)
    assert bpe_digests(docs.limit(0)).collect() == []


def test_higher_order_folds_say_the_same(spark):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = [None, "", " ", "Hello, world! <|endoftext|>", "naïve ñandú 漢字\u3000x 😀", "ab" * 40, "\n\n  \t x", "it's  we'll\u2028 9 12"]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    key = lambda r: (r.doc_id, list(r.ids))
    assert sorted(map(key, byte_bpe.encode_by_words(docs, ranks, public_tokenizers.PATTERN).collect())) == sorted(map(key, byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect()))


def test_matches_folded_together_are_folded_right():
    """Lanes against single folds: real ranks, ranks in no order with tokens out of reach, bytes without a rank."""
    rnd = random.Random(11)
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(90))) for letters in ("ab", "abcd", "etaoin", "é漢ßx", "\0a\n") for _ in range(400)})
    tokens = sorted({bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(2, 7))) for _ in range(600)} | {"é".encode(), "漢".encode()})
    mixed = dict(zip([*tokens, *(bytes([b]) for b in range(256))], rnd.sample(range(5000), len(tokens) + 256)))
    for ranks in (byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), mixed):
        found = byte_bpe.Merges(ranks).fold_all(words)
        assert {w: list(memoryview(ids).cast("i")) for w, ids in found.items()} == {w: byte_bpe.fold(w.encode(), ranks) for w in words}
    few = {b"a": 0, b"b": 1, "é".encode(): 2, "aé".encode(): 3}         # the bytes of é have no rank, joined they have
    for w in ("abaé", "ééb", "ba"):
        assert list(memoryview(byte_bpe.Merges(few).fold_all([w])[w]).cast("i")) == byte_bpe.fold(w.encode(), few)
    with pytest.raises(KeyError):
        byte_bpe.Merges(few).fold_all(["abc"])


def test_a_task_folds_new_matches_together_and_forgets_by_halves(monkeypatch):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    single, together, fold, lanes = [], [], byte_bpe.fold, byte_bpe.Merges._fold_lanes
    monkeypatch.setattr(byte_bpe, "fold", lambda piece, ranks: single.append(piece) or fold(piece, ranks))
    monkeypatch.setattr(byte_bpe.Merges, "_fold_lanes", lambda self, pieces: together.extend(pieces) or lanes(self, pieces))
    monkeypatch.setattr(byte_bpe, "MEMO", 40)
    memo = byte_bpe.Memo(byte_bpe.Merges(ranks))
    for i in range(30):
        asked = {" qzalways", "the", "x" * 70} | {f" qz{i}w{k}" for k in range(20)}
        known = memo.learn(asked)
        assert {w: list(memoryview(known[w]).cast("i")) for w in asked} == {w: fold(w.encode(), ranks) for w in asked}
        assert len(memo.ids) < 40 + len(asked) and len(memo.old) < 40 + len(asked)
    assert sorted(single) == [b"the", b"x" * 70] and len(together) == len(set(together)) == 601
    monkeypatch.setattr(byte_bpe, "MEMO_CHARS", 100)
    for i in range(5):
        memo.learn({f"{i}" * 150})
        assert len(memo.ids) == 1 or i == 0


def test_chat_events_fold(spark):
    events = [
        ("c", 1, 0, "message", "user", "hi <s>[x]&"), ("c", 2, 1, "message", "assistant", "He"), ("c", 3, 1, "delta", None, "llo"), ("c", 4, 1, "regenerate", None, "Bye"),
        ("c", 5, 1, "delta", None, "!"), ("c", 6, 0, "edit", None, "hello [ROLE]"), ("d", 1, 300, "delta", "assistant", "alone"), ("d", 2, 0, "message", None, None), (None, 1, 0, "message", "user", "q"),
    ]
    df = spark.createDataFrame([(*e, "z") for e in events], "conv_id string, seq int, target int, op string, role string, text string, chunk string")
    rows = {r.conv_id: r for r in chat_format.format_conversations(df).withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in rows["c"].turns] == [("user", "hello [ROLE]"), ("assistant", "Bye!")]
    assert [rows["c"].formatted[s.start:s.end] for s in rows["c"].loss] == ["Bye!"]
    assert [(t.role, t.text) for t in rows["d"].turns] == [("", ""), ("assistant", "alone")]
    assert [rows["d"].formatted[s.start:s.end] for s in rows["d"].loss] == ["alone"]
    assert [(t.role, t.text) for t in rows[None].turns] == [("user", "q")]
    assert chat_format.format_conversations(df.limit(0)).collect() == []


def test_chat_digests_of_turns_without_a_number_and_of_many_chunks(spark):
    """Null places come first, also before negative ones; chunks of one conversation are hashed in their order."""
    rnd = random.Random(5)
    rows = [("c", t, rnd.choice(["user", "assistant"]), f"t{t}<") for t in rnd.sample(range(-700, 700), 1200)] + [("c", None, "assistant", "first"), (None, 3, "assistant", "é"), (None, -1, None, None)]
    events = spark.createDataFrame([(c, 0, t, "message", r, x) for c, t, r, x in rows], "conv_id string, seq int, target int, op string, role string, text string").repartition(5)
    found = {r.conv_id: r for r in chat_format.digests(chat_format.render_chunks(chat_format.fold_events(events))).collect()}
    for conv in ("c", None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        under = "".join(x or "" for _, _, r, x in own if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest())
    assert len(found) == 2


def test_top_k_is_what_all_pairs_say(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.5, -0.25, 0.1, 0.5, 1.0]) for _ in range(4)], "x") for i in range(900)]
    rows += [(5, [0.5] * 4, "again"), (901, None, ""), (902, [None, 1.0, 1.0, 1.0], ""), (903, [float("nan")] * 4, ""), (904, [float("inf"), 0.0, 0.0, 0.0], ""), (None, [1.0] * 4, ""), (910, [1.0, 2.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    v = vector_search.quantised(df)
    found = vector_search.kd_topk(v, v.where("id % 100 = 0"), 10, shard_rows=128, leaf_rows=16, block_rows=4).collect()
    usable = [(i, [int(1024 * x // 1) for x in e]) for i, e, _ in rows if i is not None and e and all(x is not None and abs(x) < 1e300 for x in e)]
    expected = []
    for q, a in usable:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))[:10]
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, found)) == sorted(expected)
    assert vector_search.kd_topk(v.limit(0), v.limit(0)).collect() == []


def test_top_k_of_large_scores_and_of_a_much_repeated_id(spark):
    """Sums beyond 2^53 keep their order; copies of one id are dealt over shards; blocks in several chunks."""
    rng = random.Random(9)
    rows = [(i, [rng.randint(2**28, 2**28 + 40), rng.randint(2**28, 2**28 + 3)]) for i in range(300)] + [(7, [2**28, 2**28 + 1])] * 500
    v = spark.createDataFrame(rows, "id long, vec array<long>")
    found = vector_search.kd_topk(v, v.where("id % 10 = 0"), 3, shard_rows=64, leaf_rows=8, block_rows=1).collect()
    want = []
    for q, a in rows:
        if q % 10 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:3]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, found)) == sorted(want)
    huge = spark.createDataFrame([(i, [2**40 + i, 2**40]) for i in range(20)], "id long, vec array<long>")
    got = vector_search.kd_topk(huge, huge.where("id = 0"), 3, shard_rows=5).orderBy("rank").collect()
    assert {r.score for r in got} == {2**63 - 1} and [r.vec_id for r in got] == [1, 2, 3]      # beyond a long: equal, so by id


def test_chat_query_rows(spark):
    assert QUERIES["op5_chat_format"](spark, SF).where("conv_id = -1").first().n_turns == 2
