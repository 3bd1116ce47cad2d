"""One query per operator, over whole tables; each derives its digest columns from the operator."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.bpe import encode
from tidegate.llm.collocations import collocations
from tidegate.llm.decontamination import contaminated
from tidegate.llm.hash_tree import assign_shards, layout, number_slots
from tidegate.llm.line_dedup import remove_near_lines
from tidegate.llm.near_vectors import near_vectors
from tidegate.llm.ngram_join import jaccard_components
from tidegate.llm.packing import pack_documents
from tidegate.llm.personal_data import KINDS, personal_data
from tidegate.llm.spelling import spelling_variants
from tidegate.llm.substring_dedup import remove_repeats
from tidegate.llm.token_counts import token_counts
from tidegate.llm.toxicity import fit_toxicity, remainder, score_toxicity

#: Rows of this remainder are never learned from.
HELD_OUT = 2
SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    found = encode(_table(spark, sf_dir, "documents"), path, decoded=True)
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_near_lines(docs, distance=None, fold_digits=True).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    labels = labels.filter(remainder() != HELD_OUT)
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model, ["doc_id"]).select(
        "doc_id",
        F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
    )
    placed = assign_shards(docs, "doc_id", layout(SHARDS))
    placed = assign_shards(placed, "doc_id", layout(SHARDS + 1), "grown_shard")
    numbered = number_slots(placed, "shard", ["doc_id", "size", "text_crc32"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        "grown_shard",
    )


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(_table(spark, sf_dir, "documents"), path)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))

    def joined(spans: str) -> Column:
        one = F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"]))
        return F.array_join(one, ",")

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return personal_data(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(number(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(_table(spark, sf_dir, "documents"), path)


QUERIES = {
    "op1_bpe_encode_decode": op1_bpe_encode_decode,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_personal_data": op10_personal_data,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_best_fit_packing": op13_best_fit_packing,
}

#: Every phrase of every piece is counted, without any pruning.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
    SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
    FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
counted AS (SELECT lang, g, len(g) AS k, count(*) AS f FROM grams GROUP BY lang, g),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM counted WHERE f >= 100),
cuts AS (
    SELECT c.lang, c.g, c.f AS a, unnest(range(1, c.k)) AS cut FROM frequent c WHERE c.k > 1),
scored AS (
    SELECT cuts.lang, cuts.g, cuts.a, cut, x.f AS l, y.f AS r, n,
        (1000::HUGEINT * cuts.a * n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts JOIN totals USING (lang)
    JOIN frequent x ON x.lang = cuts.lang AND x.g = cuts.g[1:cut]
    JOIN frequent y ON y.lang = cuts.lang AND y.g = cuts.g[cut + 1:]),
lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner_phrases AS (
    SELECT DISTINCT lang, f AS a, unnest(list_transform(
        list_filter(flatten(list_transform(range(1, k + 1), lambda i: list_transform(
            range(i, k + 1), lambda j: {'low': i, 'high': j}))), lambda s: s.high - s.low + 1 < k),
        lambda s: g[s.low:s.high])) AS g
    FROM frequent WHERE k > 2),
ranked AS (
    SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score,
        row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
    FROM lowest WHERE NOT EXISTS (
        SELECT 1 FROM inner_phrases i WHERE i.lang = lowest.lang AND i.g = lowest.g AND i.a >= lowest.a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op11_phrase_collocations": COLLOCATIONS_SQL}
