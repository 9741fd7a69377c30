"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, interpolation, jaccard, langid, packing, repeats, sharding, simhash, tokenfile, toxicity
from lodestone.session import ship, table, written

Query = Callable[[SparkSession, str], DataFrame]


def held_out(mod: int, rest: int):
    """Whether crc32 of the document's id as text leaves ``rest`` (null id: the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest


def vocabulary() -> str:
    """The tokenizer file that the contracts name."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(5, 0)).select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), 2048, 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op4_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out(7, 2)).alias("train"))
    return interpolation.score(docs, 3).withColumn("held_out", held_out(7, 2))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, counts at most one apart; see :mod:`sharding`."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = sharding.uniform_shards(docs, 24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf_dir, "documents"), vocabulary(), 1)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(4, 2)).select("text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and edits; for ids divisible by 20, how many others lie within 3 bits (``n_near``)."""
    rows = written(simhash.edited_fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    return simhash.with_neighbours(rows, F.col("doc_id") % 20 == 0, 3)


def ngram_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of :func:`op4_interpolation`'s operator, learned from all documents: what SQL can check of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(True).alias("train"))
    return interpolation.score(docs, 2).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and slots of the shards of :func:`op6_sharding`."""
    return op6_sharding(spark, sf_dir).groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


def simhash_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts' lengths and edits as :func:`op10_simhash` makes them."""
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    own = [op1_toxicity, op2_packing, op3_decontamination, op4_interpolation, op5_jaccard, op6_sharding, op7_token_files, op8_suffix_dedup, op9_language_id, op10_simhash, ngram_base_scores, sharding_law, simhash_edits]
    return {q.__name__: _shipped(q) for q in own}


#: SQL for the same rows. Trained models, tokenizers and drawn shuffles are beyond it; tests hold those operators against direct programs.
_SQL = {
    "op5_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
        c AS (SELECT min(doc_id) AS text_id, count(*) AS n_copies, w FROM d WHERE len(w) > 0 GROUP BY w),
        g AS (SELECT DISTINCT text_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT text_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM c)),
        n AS (SELECT text_id, count(*) AS n FROM g GROUP BY text_id),
        l AS (SELECT u, v FROM (SELECT a.text_id AS u, b.text_id AS v, count(*) AS s FROM g a JOIN g b ON a.gram = b.gram AND a.text_id < b.text_id GROUP BY 1, 2) JOIN n x ON x.text_id = u JOIN n y ON y.text_id = v WHERE s >= 0.8 * (x.n + y.n - s)),
        e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
        r AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node),
        i AS (SELECT text_id, n_copies, w, coalesce((SELECT min(root) FROM r WHERE node = text_id), text_id) AS class_id, (SELECT count(*) FROM e WHERE u = text_id) AS n_links FROM c)
        SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(text_id, d.doc_id) AS text_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies FROM d LEFT JOIN i ON d.w = i.w
    """,
    "op8_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, j, substr(h, 1 + 400 * j, 598) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 400 + 1)) AS j FROM d WHERE length(h) >= 200)),
        w AS (SELECT doc_id, j, x, unnest(range(0, least(200, length(x) // 2 - 99))) AS q FROM c WHERE length(x) >= 200),
        f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY v ORDER BY doc_id, p) AS n FROM (SELECT doc_id, 200 * j + q AS p, substr(x, 2 * q + 1, 200) AS v FROM w)),
        g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM f WHERE n > 1),
        r AS (SELECT doc_id, k, min(p) AS s, max(p) + 100 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
        o AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b, e FROM r),
        t AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last FROM r GROUP BY doc_id),
        k AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS kept FROM o JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
          sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
    "ngram_base_scores": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        t AS (SELECT doc_id, unnest(list_append(w, ' ')) AS tok FROM d),
        c AS (SELECT tok, count(*) AS c FROM t GROUP BY tok),
        s AS (SELECT count(*) AS n, count(DISTINCT tok) AS v FROM t)
        SELECT doc_id, count(*) AS n_tokens, count(*) AS n_known, any_value(n) AS train_tokens, round(sum(log10((c + 1) / (n + v + 1))), 6) AS base_score FROM t JOIN c USING (tok), s GROUP BY doc_id
    """,
    "sharding_law": r"""
        WITH c AS (SELECT count(*) AS n FROM documents) SELECT CAST(s AS INTEGER) AS shard, CAST(n // 24 + CASE WHEN s < n % 24 THEN 1 ELSE 0 END AS BIGINT) AS n, CAST(0 AS BIGINT) AS first_slot, CAST(n // 24 + CASE WHEN s < n % 24 THEN 1 ELSE 0 END - 1 AS BIGINT) AS last_slot FROM c, range(24) AS r(s)
    """,
    "simhash_edits": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC), '') AS after FROM documents)
        SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(after, 1, length(t) // 3)) AS edited_sha256 FROM d
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
