"""The registered queries of this subpackage: each applies one operator to its whole table.

QUERIES maps a name to (spark, sf_dir) -> DataFrame, ORACLES a name to DuckDB SQL where SQL can express it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bpe_transducer, pii, places, quality_crf, sentencepiece_bpe, toxicity, url_filter
from .divergence import divergence
from .labelled import HELD_OUT, fold
from .ngram_join import similarity_classes
from .packing import pack_documents
from .quality_rules import BOILERPLATE, quality_rules
from .spelling import spelling_variants, vocabulary
from .token_counts import token_counts
from .topk_search import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; the package is part of every machine's Python."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Scores from which a document is predicted to be toxic, or good.
TOXIC_FROM, GOOD_FROM = 0.3, 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", (F.coalesce(fold(), F.lit(-1)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), F.col("toxic").alias("over_language_threshold"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 9 * c >= 4 * (x.n + y.n)
          UNION ALL SELECT a.doc_id, b.doc_id, true FROM w a JOIN w b ON len(a.w) = 0 AND len(b.w) = 0 AND a.doc_id <> b.doc_id),
reach AS (SELECT doc_id AS id, doc_id AS r FROM w UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT doc_id, (SELECT min(r) FROM reach WHERE id = doc_id) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links,
       1 + (SELECT count(*) FROM links WHERE a = doc_id AND same) AS n_copies
FROM w
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_BOILERPLATE_SQL = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
m AS (SELECT doc_id, i, line, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
             length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
             length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS symbols,
             length(regexp_replace(line, '[^|]+', '', 'g')) AS pipes,
             length(regexp_replace(line, '[^A-Z]+', '', 'g')) AS upper,
             length(regexp_replace(line, '[^a-z]+', '', 'g')) AS small,
             regexp_matches(line, '[.!?:;"'')\]][\x20\x09-\x0D]*$') AS ending,
             row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM ln),
b AS (SELECT *, words > 0 AND again AS dup,
             words > 0 AND ((pipes >= 2 AND 5 * pipes >= words) OR 10 * symbols > 3 * words OR (upper >= 5 AND upper > small)
                            OR {_BOILERPLATE_SQL} OR (NOT ending AND words < 20) OR again) AS bad FROM m),
s AS (SELECT doc_id, sum(words)::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols, count(*) FILTER (dup) AS n_dup_lines,
             count(*) FILTER (words > 0) AS n_lines, count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(chars) FILTER (bad), 0)::BIGINT AS removed_chars FROM b GROUP BY doc_id),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d)),
tri AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS tri FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM tri WHERE tri IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AND 2 * removed_chars <= word_chars AS kept, n_lines, n_bad_lines, removed_chars
FROM s LEFT JOIN rep USING (doc_id)
"""

#: Token limit of the report of op6.
TOKEN_LIMIT = 512


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice over one cache: the first pass meets misses alone and fills it, the second one has hits alone."""
    docs, cache = table(spark, sf_dir, "documents"), places.new_path(spark, "token-counts")
    token_counts(docs, tokenizer_file("byte_bpe_50k.json"), cache)
    counts = token_counts(docs, tokenizer_file("byte_bpe_50k.json"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_crf.quality(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.coalesce(fold(), F.lit(-1)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"), "n_lines", "good_lines")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


#: Every vector whose id is divisible by this is a query.
QUERY_EVERY = 20


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), k=20)


OP9_SQL = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2, capacity=1024, cache=bpe.WIDE)


#: One run in so many loses a letter, so that variants stand in the text.
TYPO_EVERY = 97


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents"), drop_every=TYPO_EVERY))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_transducer.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS runs FROM documents),
t AS (SELECT row, lang, source, translate(unnest(runs), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gr AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total
       FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang)),
p AS (SELECT gr.lang, gr.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gr.total + gr.v) AS p
      FROM gr JOIN kept k ON k.lang = gr.lang LEFT JOIN c ON c.lang = gr.lang AND c.source = gr.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + (SELECT v FROM v WHERE v.lang = c.lang)) AS q FROM c GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
         UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM gr a JOIN gr b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (FROM pair UNION ALL FROM term)) WHERE part = 'pair' OR rank <= 200
"""


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filter": op3_url_filter,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_quality_crf": op7_quality_crf,
    "op8_pii": op8_pii,
    "op9_topk_search": op9_topk_search,
    "op10_packing": op10_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES = {
    "op4_ngram_join": OP4_SQL,
    "op5_quality_rules": OP5_SQL,
    "op9_topk_search": OP9_SQL,
    "op13_source_divergence": OP13_SQL,
}
