"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, line_dedup, lm_score, media, mixing, near_embed, packing, quality, ranked, secrets, simhash, suffix_dedup, toxicity
from .common import read

#: A line is its site's boilerplate if it is on more than this part of the pages, by a bound of so many standard deviations.
LINE_RATIO, LINE_SURE = 0.1, line_dedup.SURE


#: Of a training sequence: pieces, and tokens that bear loss (so at least 3 pieces fill one of 2048 tokens).
SEGMENTS, LOSS_TOKENS = 32, 2045


def fold(id_col: str = "doc_id") -> Column:
    """The number of a document's fifth: crc32 of its id as text, modulo 5; of a null id -1, which is in none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(-1))


def op1_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_embed.near(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", least=0.9)
    return out.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.without_boilerplate(docs, "text", "source", LINE_RATIO, LINE_SURE)
    return out.select("doc_id", "kept_text", "n_dropped")


OP2_SQL = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
on_page AS (SELECT DISTINCT doc_id, source, trim(l) AS line FROM (SELECT doc_id, source, unnest(ls) AS l FROM pages) WHERE trim(l) <> ''),
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
boiler AS (SELECT o.source, o.line FROM on_page o JOIN totals t ON o.source IS NOT DISTINCT FROM t.source
  GROUP BY o.source, o.line, t.n HAVING count(*) > 1 AND (count(*) / t.n + {LINE_SURE * LINE_SURE} / (2 * t.n) - {LINE_SURE} * sqrt(count(*) / t.n * (1 - count(*) / t.n) / t.n + {LINE_SURE * LINE_SURE} / (4 * t.n * t.n))) / (1 + {LINE_SURE * LINE_SURE} / t.n) > {LINE_RATIO}),
by_site AS (SELECT source, list(line) AS lines FROM boiler GROUP BY source)
SELECT p.doc_id,
  CASE WHEN p.text IS NULL THEN NULL ELSE array_to_string(list_filter(p.ls, lambda l: NOT coalesce(list_contains(b.lines, trim(l)), false)), chr(10)) END AS kept_text,
  len(p.ls) - len(list_filter(p.ls, lambda l: NOT coalesce(list_contains(b.lines, trim(l)), false))) AS n_dropped
FROM pages p LEFT JOIN by_site b ON p.source IS NOT DISTINCT FROM b.source
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~fold().isin(0, -1))
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    return toxicity.scored(docs, model, "text").select(
        "doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), segments=SEGMENTS, loss_tokens=LOSS_TOKENS)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(read(spark, sf_dir, "documents"), length=100)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_score.scored(docs, ~fold().isin(1, -1), order=3)
    return out.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.kept_media(read(spark, sf_dir, "documents")), with_tensor=True).withColumnRenamed("id", "doc_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.grouped(docs, "doc_id", "text", shingle=3, radius=2)
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mixed(docs)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM docs),
windows AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS three FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM split WHERE len(ws) >= 3)),
often AS (SELECT r, three FROM windows GROUP BY r, three HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM windows JOIN often USING (r, three), (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
base AS (SELECT s.r, doc_id, source, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM split s LEFT JOIN covered c ON s.r = c.r),
lines AS (SELECT r, source, t, regexp_replace(array_to_string(regexp_extract_all(lower(l), '[^\x20\x09-\x0D]+'), ' '), '[0-9]', '0', 'g') AS line, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT r, source, t, unnest(ls) AS l FROM split)),
frequent AS (SELECT source, line FROM lines GROUP BY source, line HAVING count(DISTINCT t) > 10),
lost AS (SELECT r, sum(words)::BIGINT AS n FROM lines l JOIN frequent f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY r),
told AS (SELECT b.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(l.n, 0) AS gone FROM base b LEFT JOIN lost l ON b.r = l.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - gone >= 0.5 * n_words AS kept,
  (CASE WHEN base_failed THEN n_words ELSE n_words - gone END)::BIGINT AS words_left
FROM told
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_blocks and n_read are left out, as they depend on how the table is cut into shards."""
    indexed = ranked.index(read(spark, sf_dir, "documents"))
    return ranked.search(indexed, read(spark, sf_dir, "benchmark"), k=50).select("item_id", "rank", "doc_id", "score")


OP12_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
sized AS (SELECT r, doc_id, len(ws)::BIGINT AS n, ws FROM words WHERE len(ws) > 0),
totals AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sized),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM sized) GROUP BY r, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, text,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weights AS (SELECT item_id, text, term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM asked JOIN df USING (term), totals),
scored AS (SELECT item_id, text, r, any_value(doc_id) AS doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))))::BIGINT AS score
  FROM weights JOIN tf USING (term) JOIN sized USING (r), totals GROUP BY item_id, text, r),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_embeddings": op1_near_embeddings,
        "op2_line_dedup": op2_line_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_packing": op4_packing,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_lm_score": op6_lm_score,
        "op7_secrets": op7_secrets,
        "op8_simhash": op8_simhash,
        "op9_media": op9_media,
        "op10_mixing": op10_mixing,
        "op11_quality": op11_quality,
        "op12_ranked_search": op12_ranked_search,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op11_quality": OP11_SQL, "op12_ranked_search": OP12_SQL}
