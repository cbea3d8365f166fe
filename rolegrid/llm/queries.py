"""Registered queries of the corpus operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.llm import (
    byte_bpe, collocations, decontaminate, html_blocks, kneser_ney, minhash, packing, quality_rules, secret_scan, substrings, token_edits, toxicity,
    va_clusters,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts, a digest of the base findings, all spans."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda f: f["kind"] != "cnn")
    spelled = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(
        ":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"),
                        spelled(F.col("findings")).alias("spans"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on two-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op3_token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after edits all over its text.

    The edits come from the text itself: one for every 1000 code points, at
    least one, each deleting up to six and inserting up to twelve code points
    of another place.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    last = F.floor(F.length("text") / 1000).cast("int")
    docs = docs.withColumn("edits", F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        (i * 983 + 7).alias("start"), (i % 7).alias("deleted"),
        F.col("text").substr(i * 611 + 1, i % 13).alias("inserted"))))
    path = tokenizer_path()
    return token_edits.recount(token_edits.build(docs, path), path)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item."""
    found = decontaminate.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of four folds of five."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that an earlier document has in the same window."""
    return substrings.dedup(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into windows of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of bounds and outlier test."""
    return quality_rules.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under its language's trusted text, and the verdict."""
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    import public_tokenizers

    path, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = byte_bpe.encode(_table(spark, sf_dir, "documents"), path, pattern, keep_places=False)
    return byte_bpe.decode(tokens, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language by how much their words attract each other."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding with its cluster after ten rounds."""
    return va_clusters.report(_table(spark, sf_dir, "embeddings"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_minhash": op2_minhash,
    "op3_token_edits": op3_token_edits,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_substrings": op6_substrings,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_html_blocks": op10_html_blocks,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_collocations": op12_collocations,
    "op13_va_clusters": op13_va_clusters,
}

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = f"regexp_extract_all({_AZ}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark),
        p AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS g,
                     least(13, len(w)) AS n
              FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS k
                    FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM p),
        g AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
              FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k
                    FROM d, sizes WHERE len(w) >= n)),
        h AS (SELECT g.doc_id, g.k, g.n, p.item_id FROM g JOIN p ON g.g = p.g AND g.n = p.n),
        hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit
                FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS j FROM h) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_substrings": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
                   FROM documents),
        g AS (SELECT doc_id, k, sha256(array_to_string(list_slice(w, k, k + 49), ' ')) AS g
              FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS k FROM d WHERE len(w) >= 50)),
        lows AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY g),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 49)) AS j
                 FROM g JOIN lows USING (g) WHERE doc_id > lo),
        cut AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
        kept AS (SELECT doc_id, len(w) AS n, coalesce(len(js), 0) AS r,
                        list_select(w, list_filter(generate_series(1, len(w)),
                                    lambda j: js IS NULL OR NOT list_contains(js, j))) AS k
                 FROM d LEFT JOIN cut USING (doc_id))
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept""",
    "op12_collocations": f"""
        WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
                   FROM (SELECT coalesce(lang, 'und') AS lang,
                                unnest(regexp_extract_all({_AZ}, '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM documents)),
        g AS (SELECT lang, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS phrase
              FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k
                    FROM p, (VALUES (1), (2), (3)) AS s(size) WHERE len(w) >= size)),
        f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
        t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
        inside AS (SELECT lang, phrase, max(a) AS m
                   FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE size = 3)
                   GROUP BY ALL),
        kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE m IS NULL OR 100 * m < 50 * a),
        cuts AS (SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
                 FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM kept)),
        scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, fx.a AS l, fy.a AS r,
                          CAST((1000000::HUGEINT * cuts.a * cuts.a) // (fx.a::HUGEINT * fy.a) AS BIGINT) AS score
                   FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x
                             JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, score
        FROM best JOIN t USING (lang) QUALIFY rank <= 2000""",
}
