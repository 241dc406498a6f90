"""The numbered queries over the driver's tables and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.minhash import near_duplicates
from gristmill.llm.quality_classifier import score_documents
from gristmill.llm.quality_rules import statistics
from gristmill.llm import alignment, bpe, chat, collocations, html_extract, mixing, secret_scan, sharding, syncmers, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, linked from 85 % of common shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op6_minhash_dedup"] = op6_minhash_dedup


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the rule cascade's verdict for all documents."""
    return statistics(_table(spark, sf_dir, "documents"))


QUERIES["op9_quality_rules"] = op9_quality_rules
ORACLES["op9_quality_rules"] = r"""
    WITH base AS (
        SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
        FROM documents),
    windows AS (
        SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n
        FROM (SELECT id, i, [w[i], w[i + 1], w[i + 2]] AS g
              FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3))),
    repeated AS (
        SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n >= 2) GROUP BY id),
    counted AS (
        SELECT doc_id, text, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
               CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
               CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
        FROM base LEFT JOIN repeated r USING (id)),
    failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 100 * n_symbols > 20 * n_words
                OR length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) > length(regexp_replace(text, '[^a-zß-öø-ÿ]+', '', 'g'))
                OR 100 * n_dup_lines > 50 * len(lines)
                OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
    FROM failed
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts and spans of the base kinds, and all spans."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in secret_scan.BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"))


def _secrets_sql() -> str:
    """The same spans from DuckDB's splits and matches."""
    fields, joined = [], []
    for i, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("'", "''")
        fields.append(f"regexp_extract_all(text, '{p}') AS m{i}, regexp_extract_all(text, '{p}', {r.group}) AS o{i}, regexp_split_to_array(text, '{p}') AS g{i}")
        at = f"(coalesce(list_sum(list_transform(g{i}[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m{i}[1:k - 1], lambda x: length(x))), 0))"
        joined.append(f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda k: length(o{i}[k]) >= {r.least}), lambda k: {{'s': CAST({at} AS BIGINT), 'r': {i}, 'e': CAST({at} + length(m{i}[k]) AS BIGINT), 'k': '{r.kind}'}})")
    text = "array_to_string(list_transform({0}, lambda s: s.k || ':' || s.s || ':' || s.e), ',')"
    counts = ", ".join(f"CAST(len(list_filter(spans, lambda s: s.k = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    base = text.format(f"list_filter(spans, lambda s: s.r < {len(secret_scan.BASE_RULES)})")
    return f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        found AS (SELECT doc_id, {', '.join(fields)} FROM texts),
        sorted AS (SELECT doc_id, list_sort(list_concat({', '.join(joined)})) AS spans FROM found)
        SELECT doc_id, {counts}, sha256({base}) AS base_sha256, {text.format('spans')} AS spans FROM sorted"""


QUERIES["op2_secret_scan"] = op2_secret_scan
ORACLES["op2_secret_scan"] = _secrets_sql()


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    return mixing.shares(_table(spark, sf_dir, "documents"))


QUERIES["op8_mixing"] = op8_mixing


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and digests of their ids and of the decoded text."""
    return bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


QUERIES["op3_bpe"] = op3_bpe


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return syncmers.fingerprints(_table(spark, sf_dir, "documents"))


QUERIES["op10_syncmers"] = op10_syncmers


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op1_quality_classifier"] = op1_quality_classifier


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


QUERIES["op5_warc"] = op5_warc
ORACLES["op5_warc"] = """
    WITH base AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    named AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM base),
    tops AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM named)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
    FROM tops
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], table.schema)
    return chat.digests(table.unionByName(extra))


QUERIES["op7_chat"] = op7_chat
ORACLES["op7_chat"] = r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
        UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
    joined AS (
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
               CAST(sum(length(role) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id)
    SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
    FROM joined
"""


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


QUERIES["op4_html"] = op4_html


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens that two tokenizers give for all documents."""
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op11_alignment"] = op11_alignment


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal weight, and where 25 would put them."""
    shards = sharding.equal_weights(sharding.SHARDS)
    placed = sharding.numbered(_table(spark, sf_dir, "documents"), shards, sharding.equal_weights(len(shards) + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES["op12_sharding"] = op12_sharding


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language of all documents."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES["op13_collocations"] = op13_collocations
