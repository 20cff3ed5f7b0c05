"""The queries of this package: name -> builder, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.llm import (byte_bpe, chat_format, decontaminate, jaccard_join, language_id, license_scan, packing, prefix_trie, secret_scan,
                        token_alignment, toxicity, url_filter, vector_search)
from curata.llm.common import read_table, sha256_hex
from curata.session import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_kd_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op1_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_search.quantised(read_table(spark, sf_dir, "embeddings"))
    return vector_search.kd_topk(vectors, vectors.where(F.col("id") % 100 == 0), k=10)


@register("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", *(["ids"] if with_ids else []), F.size("ids").cast("long").alias("n_tokens"), sha256_hex(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                          sha256_hex(byte_bpe.decode_column(F.col("ids"), ranks)).alias("decoded_sha256"))


@register("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"), words=4, percent=85)


#: Fixed values of the url query: rule and what it says.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@register("op4_url_filter")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a page: those of the document with its number; toxic or low quality is bad.

    Pages and documents are unrelated in these tables, so the labels tell nothing about urls and no rule is expected to
    beat the classes' shares by much: the query measures the machinery, tests with labels that depend on urls its rules."""
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), labels, URL_RULES)


@register("op5_chat_format", """
WITH e AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
x AS (SELECT *, replace(replace(replace(role, '&', '&a;'), '<', '&l;'), '[', '&b;') AS er, replace(replace(replace(text, '&', '&a;'), '<', '&l;'), '[', '&b;') AS et FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(er) + length(et)) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
""")
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # the log of these turns: assistant texts are streamed in two parts, user texts edited into place, others regenerated
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    k = 2 * F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(role, text))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda seq, op, part: F.struct(seq.alias("seq"), F.lit(op).alias("op"), part.alias("text"))
    streamed = F.array(event(F.col("k"), "message", F.substring(text, F.lit(1), half)), event(F.col("k") + 1, "delta", F.substring(text, half + 1, F.length(text))))
    replaced = lambda op: F.array(event(F.col("k"), "message", F.lit("draft")), event(F.col("k") + 1, op, text))
    log = F.when(role == "assistant", streamed).when(role == "user", replaced("edit")).otherwise(replaced("regenerate"))
    events = rows.withColumn("k", k).select("conv_id", F.col("turn").alias("target"), "role", F.explode(log).alias("e")).select("conv_id", "target", "e.seq", "e.op", "role", "e.text")
    return chat_format.digests(chat_format.render_chunks(chat_format.fold_events(events)))


@register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    vocabulary = language_id.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    langs, prob = language_id.train(language_id.training_sample(docs.where(~held_out), train_docs=300), vocabulary)
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.predict_column(F.col("text"), langs, prob, vocabulary, spark).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


@register("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is the file ``<source>/<lang>/<doc_id>``."""
    docs = read_table(spark, sf_dir, "documents")
    return license_scan.scan_licenses(docs, path=F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


@register("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                        sha256_hex(secret_scan.span_text(base)).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


@register("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = toxicity.judge_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), "toxic")


@register("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, specials = packing.load_byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, specials)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, _ = packing.load_byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        pieces = f.read()
    aligned = token_alignment.align_documents(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, pieces)
    digest = F.when(F.col("groups") == "", "").otherwise(sha256_hex(F.col("groups"))).alias("groups_sha256")
    kept = [c for c in aligned.columns if c != "groups"]
    return token_alignment.with_scores(checkpointed(aligned.select(*kept, digest), "alignment"))


@register("op11_prefix_trie", """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (
  SELECT *, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS sha FROM t),
c AS (
  SELECT conv_id, list({'sha': sha, 'size': strlen(text)} ORDER BY turn NULLS FIRST, role, sha) AS own FROM d GROUP BY conv_id),
h AS (      -- crc32 of the decimal id, bit by bit
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
           lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
         lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)),
           lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h FROM c),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS seq
  FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (
  SELECT conv_id, d AS depth, len(seq) AS n, sha256(array_to_string(list_transform(seq[1:d], lambda x: x.sha), ',')) AS k,
         CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(seq[1:d - 1], lambda x: x.sha), ',')) END AS up,
         CASE WHEN d > 0 THEN seq[d].size ELSE 0 END AS size
  FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM r)),
node AS (
  SELECT k, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM p GROUP BY k, depth),
kids AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY ALL),
way AS (     -- every node with each of its ancestors and itself
  SELECT DISTINCT p.k AS k, p.depth AS depth, q.k AS top, q.depth AS top_depth FROM p JOIN p q ON p.conv_id = q.conv_id AND q.depth <= p.depth),
sums AS (
  SELECT way.top, way.top_depth, count(*) FILTER (kids.n_children IS NULL) AS n_leaves, sum((node.n_convs - 1) * node.size) AS saved_tokens
  FROM way JOIN node USING (k, depth) LEFT JOIN kids ON kids.up = node.k AND kids.depth = node.depth GROUP BY ALL)
SELECT node.conv_id, node.depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n_children, 0) AS n_children,
  sums.n_leaves, CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node LEFT JOIN node above ON above.k = node.up AND above.depth = node.depth - 1
  LEFT JOIN kids ON kids.up = node.k AND kids.depth = node.depth
  JOIN sums ON sums.top = node.k AND sums.top_depth = node.depth
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = checkpointed(prefix_trie.numbered_turns(read_table(spark, sf_dir, "conversations")), "numbered")
    conv = F.col("conv_id")
    rebuilt = prefix_trie.regrafted(numbered, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9)
    return prefix_trie.prefix_trie(rebuilt)
