"""The queries of this subpackage: thin applications of its operators to whole tables, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from ._shared import table

#: Fixed rules of the url query: (host, path prefix).
BLOCK = ["com/en/", "example.net/de/8", "org/es/"]
ALLOW = ["example.com/en/7", "net/de/"]
#: Fixed weights of the mixing query.
WEIGHTS, SHARE, MOST = [5, 2, 1], 1.5, 2.0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages"), BLOCK, ALLOW)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import fair_queue

    return fair_queue(table(spark, sf_dir, "documents"), WEIGHTS, SHARE, MOST).select("doc_id", "size", "source_size", "target", "taken", "times")


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", "text")


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import audits, damaged, repair

    return audits(repair(damaged(table(spark, sf_dir, "conversations"))))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import alignment

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_tokens": op2_tokens,
    "op3_urls": op3_urls,
    "op4_warc": op4_warc,
    "op5_decontaminate": op5_decontaminate,
    "op6_neardup": op6_neardup,
    "op7_mixing": op7_mixing,
    "op8_ppm": op8_ppm,
    "op9_linededup": op9_linededup,
    "op10_imatch": op10_imatch,
    "op11_repair": op11_repair,
    "op12_language": op12_language,
    "op13_alignment": op13_alignment,
}
QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}



def _repair_sql() -> str:
    """Edits by a recursive search over a conversation's rows: the cheapest (cost, audit, turns) of each state of the grammar."""
    least = lambda *xs: f"list_sort([{', '.join(xs)}], 'ASC', 'NULLS LAST')[1]"
    said = lambda o, x: f"CASE WHEN {o} = '' THEN {x} ELSE {o} || chr(10) || {x} END"

    def step(s: str, cost: str, letter: str, turn: str | None = None, where: str = "true") -> str:
        return f"CASE WHEN {s} IS NOT NULL AND ({where}) THEN {{'c': ({s}.c + {cost})::BIGINT, 'a': {s}.a || '{letter}', 'o': {said(s + '.o', turn) if turn else s + '.o'}}} END"

    keep = lambda s, initial: step(s, "tr", "K", "role || ':' || text", f"NOT gone AND role[1] = '{initial}'")
    own = lambda s, role: step(s, "2 + tr", "R", f"'{role}:' || text", "NOT gone")
    new = lambda s, role: step(s, "2", "I", f"'{role}:'")
    to_user = ("s0", "s1", "s3")
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
        WITH RECURSIVE t AS (SELECT list(list_reduce([i] || [0::BIGINT for z in range(8)], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
        b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, [4294967295::BIGINT] || [ascii(x)::BIGINT for x in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS b FROM conversations),
        k AS (SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 20 AS k FROM b, t),
        m AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, (SELECT unnest([1, 2]) AS copy) WHERE k <> 0 AND (copy = 1 OR k = 3)),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, rtrim(text, {space}) AS seen FROM m),
        f AS (SELECT *, seen = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
        g AS (SELECT *, blank OR again AS gone, (NOT blank AND right(seen, 1) NOT IN ('.', '!', '?'))::BIGINT AS tr FROM f),
        w AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS s1, {{'c': 2::BIGINT, 'a': 'I', 'o': 'user:'}} AS s2, {{'c': 4::BIGINT, 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:'}} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, i, s0, s1, s2, {least("s3", new("s2", "assistant"))} AS s3 FROM (
            SELECT conv_id, i, s0, s1, {least("s2", *(new(s, "user") for s in to_user))} AS s2, s3 FROM (
            SELECT w.conv_id, g.i, {step("s0", "3", "D")} AS s0, {least(step("s1", "3", "D"), keep("s0", "s"))} AS s1,
                   {least(step("s2", "3", "D"), *(keep(s, "u") for s in to_user), *(own(s, "user") for s in to_user))} AS s2,
                   {least(step("s3", "3", "D"), keep("s2", "a"), own("s2", "assistant"))} AS s3
            FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1))),
        e AS (SELECT conv_id, arg_max({least("s0", "s3")}, i) AS e FROM w GROUP BY conv_id),
        h AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT gone AND tr = 1) AS truncated, count(*) FILTER (before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
        SELECT e.conv_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, e.c::BIGINT AS cost, e.a AS audit, sha256(e.o) AS repaired_sha256 FROM e LEFT JOIN h ON e.conv_id IS NOT DISTINCT FROM h.conv_id
    """


ORACLE_SQL: dict[str, str] = {
    "op11_repair": _repair_sql(),
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS digest FROM pages),
        k AS (SELECT digest, max(page_id) AS keeper FROM p WHERE octet_length(body) >= 1000 GROUP BY digest)
        SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN keeper <> page_id THEN keeper END AS refers_to
        FROM p LEFT JOIN k ON p.digest = k.digest AND octet_length(body) >= 1000
    """,
    "op7_mixing": """
        WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS s, coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0)::BIGINT AS size,
                          md5(coalesce(doc_id::VARCHAR, '#' || md5(coalesce(text, '')))) AS key FROM documents),
        z AS (SELECT s, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY s) - 1 AS rank FROM d GROUP BY s),
        w AS (SELECT *, [5, 2, 1][(rank % 3 + 1)::INTEGER] AS weight, source_size * 2.0::DOUBLE AS cap FROM z),
        l AS (SELECT *, cap / weight AS own,
                     (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
        f AS (SELECT s, source_size, weight, cap, CASE WHEN own <= level THEN cap ELSE weight * (SELECT arg_min(level, (own, rank)) FROM l WHERE own > level) END AS target FROM l),
        u AS (SELECT s, weight, unnest(range(1, cap::BIGINT + 1)) AS position FROM f),
        m AS (SELECT s, count(*) AS cut FROM (SELECT s, row_number() OVER (ORDER BY position / weight, s) AS place FROM u) WHERE place <= (SELECT sum(floor(target)) FROM f) GROUP BY s),
        q AS (SELECT d.*, f.source_size, f.target, coalesce(cut, 0) AS cut, coalesce(sum(size) OVER (PARTITION BY d.s ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN f USING (s) LEFT JOIN m USING (s)),
        g AS (SELECT *, least(size, greatest(0, cut - start))::BIGINT AS a, least(size, greatest(0, cut - source_size - start))::BIGINT AS b FROM q)
        SELECT doc_id, size, source_size, target, a + b AS taken, ((a > 0)::INTEGER + (b > 0)::INTEGER) AS times FROM g
    """,
}
