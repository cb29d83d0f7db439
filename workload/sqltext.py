"""Pieces of SQL that several statements share."""

from __future__ import annotations

from opinara import settings
from workload import tables

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def texts(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def rows(values) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else repr(v) for v in row) + ")" for row in values)


def rnd(value: str, digits: int) -> str:
    """Half-up on the decimal digits of a double."""
    return f"CAST(round(CAST({value} AS DECIMAL(38,15)), {digits}) AS DOUBLE)"


def avg(digits: int | None, value: str = "r.rating") -> str:
    mean = f"avg({value})"
    return rnd(mean, digits) if digits is not None else rnd(mean, 9)


def pct(label: str, digits: int | None, count: str = "count(*)") -> str:
    share = f"100.0::DOUBLE * sum(CASE WHEN r.sentiment_label = '{label}' THEN 1 ELSE 0 END) / nullif({count}, 0)"
    return rnd(share, 9 if digits is None else digits)


REVIEWS = """
reviews AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id, l_partkey AS business_id,
         CAST(1 + (CAST(trunc(l_quantity) AS BIGINT) % 5) AS DOUBLE) AS rating,
         CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS review_date,
         CASE WHEN l_linenumber <> 7 THEN CAST(year(l_shipdate) AS BIGINT) END AS review_year,
         CASE WHEN l_linenumber <> 7 THEN CAST(month(l_shipdate) AS BIGINT) END AS review_month,
         l_linestatus AS source,
         CASE l_returnflag WHEN 'N' THEN 'Positive' WHEN 'A' THEN 'Neutral' WHEN 'R' THEN 'Negative' END AS sentiment_label
  FROM lineitem),
businesses AS (
  SELECT p_partkey AS business_id, p_name AS name, CASE WHEN p_partkey % 20 <> 0 THEN p_brand END AS city_id,
         p_type AS category_id FROM part
  UNION ALL
  SELECT -1 - s_suppkey, s_name, n_name, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cities AS (
  SELECT DISTINCT p_brand AS city_id, p_brand AS city_name,
         CASE WHEN CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) % 5 <> 0
              THEN CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) END AS latitude,
         -CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS longitude FROM part
  UNION ALL
  SELECT n_name, n_name, NULL, NULL FROM nation),
categories AS (SELECT DISTINCT p_type AS category_id, p_type AS category_name FROM part)"""

TEXT_REVIEWS = """
text_reviews AS (
  SELECT d.doc_id AS review_id, d.text AS review_text, d.source AS business_name,
         CASE l.quality WHEN 1 THEN 'Positive' WHEN 0 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

YM = "printf('%04d-%02d', r.review_year, r.review_month)"
CHAIN = "reviews r JOIN businesses b ON r.business_id = b.business_id"
CITY = f"{CHAIN} JOIN cities c ON b.city_id = c.city_id"
CATEGORY = f"{CHAIN} JOIN categories g ON b.category_id = g.category_id"
WIDE = f"{CHAIN} LEFT JOIN cities c ON b.city_id = c.city_id LEFT JOIN categories g ON b.category_id = g.category_id"
MIN = settings.MIN_REVIEWS


def star(sql: str, *more: str) -> str:
    return "WITH " + ",".join([REVIEWS, *more]) + "\n" + sql


def pattern(phrases) -> str:
    return f"(^|{NOT_WORD})({'|'.join(phrases)})({NOT_WORD}|$)"


def mentions(where: str = "WHERE sentiment_label = 'Negative'") -> str:
    parts = [
        f"SELECT review_id, business_name, {q(name)} AS category, {i} AS pos FROM text_reviews "
        f"WHERE regexp_matches(lower(review_text), {q(pattern(phrases))})"
        for i, (name, phrases) in enumerate(tables.COMPLAINTS.items())
    ]
    source = f"(SELECT * FROM text_reviews {where})"
    return "mentions AS (" + " UNION ALL ".join(p.replace("FROM text_reviews", f"FROM {source}") for p in parts) + ")"


def of_text(sql: str, *more: str) -> str:
    return "WITH " + ",".join([TEXT_REVIEWS, *more]) + "\n" + sql
