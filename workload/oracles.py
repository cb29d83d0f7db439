"""Name -> the same result in SQL, over the same tables."""

from __future__ import annotations

from opinara import settings
from opinara.operators.sentiment import Rules
from workload import tables
from workload.insight_sql import MONTH, insights_sql, line_mentions
from workload.sqltext import (
    CASED, CATEGORY, CHAIN, CITY, MIN, NOT_WORD, SPACE, WIDE, WORD, YM, avg, mentions, of_text, pct, q, rnd, rows, star, texts,
)


def listed(measure: str, tail: str, having: str = "") -> str:
    return star(
        f"""SELECT b.business_id, b.name AS business_name, c.city_name, g.category_name, {avg(2)} AS avg_rating,
        count(*) AS review_count{measure} FROM {WIDE}
        GROUP BY b.business_id, b.name, c.city_name, g.category_name HAVING count(*) >= {MIN} {having} {tail}"""
    )


def with_city(direction: str) -> str:
    return star(
        f"""SELECT b.business_id, b.name AS business_name, c.city_name, {avg(2)} AS avg_rating, count(*) AS review_count
        FROM {CITY} GROUP BY b.business_id, b.name, c.city_name HAVING count(*) >= 10
        ORDER BY avg_rating {direction}, business_name, b.business_id LIMIT 10"""
    )


def average_by(joined: str, name: str, limit: str = "") -> str:
    return star(
        f"""SELECT {name}, {avg(2)} AS avg_rating, count(*) AS review_count FROM {joined} GROUP BY {name}
        HAVING count(*) >= {MIN} ORDER BY avg_rating DESC, {name} {limit}"""
    )


def performance(joined: str, name: str) -> str:
    return star(
        f"""SELECT {name}, count(*) AS review_count, {avg(2)} AS avg_rating, {pct('Positive', 1)} AS positive_pct,
        {pct('Negative', 1)} AS negative_pct, count(DISTINCT b.business_id) AS business_count
        FROM {joined} GROUP BY {name} HAVING count(*) >= {MIN}"""
    )


PROFILE = f"""profile AS (
  SELECT b.name, {avg(2)} AS avg_rating, count(*) AS review_count, {pct('Positive', 1)} AS positive_pct,
         {pct('Negative', 1)} AS negative_pct, {pct('Neutral', 1)} AS neutral_pct
  FROM {CHAIN} WHERE b.name IN {texts(tables.NAMES)} GROUP BY b.name)"""

PER_CITY = f"per_city AS (SELECT c.city_name, count(*) AS review_count FROM {CITY} GROUP BY c.city_name)"

MONTHS = f"""months AS (
  SELECT {YM} AS year_month, count(*) AS review_count, {avg(3)} AS avg3, avg(r.rating) AS avg_raw
  FROM reviews r WHERE review_year IS NOT NULL AND review_month IS NOT NULL GROUP BY review_year, review_month)"""


def declining(minimum: int, digits: int | None, tail: str) -> str:
    both = {d: (lambda v, d=d: rnd(v, d) if d is not None else v) for d in (digits,)}[digits]
    return star(
        f"""SELECT business_id, business_name, {rnd('all_time_avg', 9)} AS all_time_avg, {rnd('recent_avg', 9)} AS recent_avg,
        {rnd('recent_avg - all_time_avg', digits if digits is not None else 9)} AS rating_change, total_reviews
        FROM (SELECT r.business_id, b.name AS business_name, {both('avg(rating)')} AS all_time_avg,
                {both(f"avg(CASE WHEN review_date >= DATE '{tables.AS_OF}' - INTERVAL 6 MONTH THEN rating END)")} AS recent_avg,
                count(*) AS total_reviews
              FROM {CHAIN} GROUP BY r.business_id, b.name HAVING count(*) >= {minimum})
        WHERE recent_avg < all_time_avg ORDER BY rating_change, business_name, business_id {tail}"""
    )


def null_summary() -> str:
    kinds = {
        "review_id": "string", "business_id": "bigint", "rating": "double", "review_date": "date", "review_year": "int",
        "review_month": "int", "source": "string", "sentiment_label": "string",
    }
    empty = "SELECT 'review_text' AS \"column\", count(*) AS null_count, 100.0::DOUBLE AS null_pct, 'string' AS dtype FROM reviews"
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
        f"{rnd(f'100.0::DOUBLE * (count(*) - count({c})) / count(*)', 2)} AS null_pct, '{k}' AS dtype FROM reviews"
        for c, k in kinds.items()
    ]
    return star(" UNION ALL ".join([empty, *parts]))


def title(value: str) -> str:
    runs = f"regexp_extract_all({value}, '[{CASED}]+|[^{CASED}]')"
    return f"array_to_string(list_transform({runs}, lambda w: CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '')"


def city(value: str) -> str:
    name = f"regexp_replace({value}, '^{SPACE}+|{SPACE}+$', '', 'g')"
    known = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in settings.CITY_ALIASES.items())
    return (
        f"CASE WHEN {value} IS NULL OR {name} = '' THEN 'Unknown' "
        f"ELSE coalesce(CASE lower({name}) {known} END, {title(name)}) END"
    )


def normalised(value: str) -> str:
    quotes = f"translate(regexp_replace({value}, '<[^>]+>', ' ', 'g'), '‘’“”', '''''\"\"')"
    return f"trim(regexp_replace(nfc_normalize({quotes}), '{SPACE}+', ' ', 'g'))"


RAW = """raw AS (
  SELECT CASE n_chars % 11 WHEN 0 THEN 'abc' WHEN 1 THEN '0.5' WHEN 2 THEN '6' WHEN 3 THEN NULL WHEN 4 THEN '5d' WHEN 5 THEN '4f' WHEN 6 THEN '0x1p1'
              ELSE CAST(n_chars % 5 + 1 AS VARCHAR) END AS stars,
         CASE WHEN n_chars % 13 = 0 THEN chr(160) || chr(9) || ' '
              ELSE replace(replace(text, 'é', 'e' || chr(769)), '. ', '.' || chr(160) || '<br/>' || chr(8217) || chr(9) || ' ') END AS text,
         'Shop ' || CAST(n_chars % 10 AS VARCHAR) AS name,
         CASE n_chars % 7 WHEN 0 THEN NULL WHEN 1 THEN ' NYC ' WHEN 2 THEN 'o''fallon-' || lang ELSE lang END AS city,
         CASE n_chars % 3 WHEN 0 THEN strftime(DATE '2020-01-01' + CAST(n_chars % 1000 AS INTEGER), '%Y-%m-%d')
              WHEN 1 THEN strftime(DATE '2020-01-01' + CAST(n_chars % 1000 AS INTEGER), '%m/%d/%Y')
              ELSE '2 hafta önce' END AS date,
         CASE WHEN n_chars % 2 = 0 THEN 'Dinner' END AS visit_details
  FROM documents)"""
VALID = "coalesce(TRY_CAST(stars AS DOUBLE) BETWEEN 1 AND 5, false)"
SHOWN = f"coalesce(regexp_replace(text, '{SPACE}', '', 'g'), '') <> ''"
DAY = "CAST(coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%m/%d/%Y')) AS DATE)"

CANONICAL = """rows AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id,
         CAST(1 + (CAST(trunc(l_quantity) AS BIGINT) % 5) AS DOUBLE) AS rating, p_name AS name,
         CASE WHEN p_partkey % 20 <> 0 THEN p_brand END AS city, p_type AS category,
         CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS day, p_size, p_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BUSINESS_KEY = "sha256(name || chr(31) || coalesce(city, chr(30)))"

WORDS3 = (
    f"list_filter(regexp_extract_all(lower(review_text), '{WORD}+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') "
    f"AND w NOT IN {texts(settings.STOP_WORDS)})"
)


def weighted(group: str, where: str = "") -> str:
    tokens = (
        f"list_filter(regexp_extract_all(lower(review_text), '{WORD}+'), lambda w: length(w) >= 2 "
        f"AND w NOT IN {texts(settings.STOP_WORDS)})"
    )
    return f"""
texts AS (SELECT {group} AS grp, review_id AS id, {tokens} AS t FROM text_reviews {where}),
single AS (SELECT grp, id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM texts),
grams AS (SELECT grp, id, term FROM single UNION ALL
  SELECT grp, id, term || ' ' || next FROM (SELECT *, lead(term) OVER (PARTITION BY id ORDER BY pos) AS next FROM single)
  WHERE next IS NOT NULL),
tf AS (SELECT grp, id, term, count(*) AS tf FROM grams GROUP BY ALL),
seen AS (SELECT grp, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= 2),
kept AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY grp ORDER BY total DESC, term) <= 5000),
size AS (SELECT grp, count(*) AS n FROM texts GROUP BY grp),
w AS (SELECT tf.grp, id, tf.term, n, tf.tf * (ln((1 + n) / (1 + df)) + 1) AS w
  FROM tf JOIN kept ON tf.grp = kept.grp AND tf.term = kept.term JOIN size ON tf.grp = size.grp),
unit AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM w),
score AS (SELECT grp, term, {rnd('sum(u) / max(n)', 12)} AS score FROM unit GROUP BY grp, term),
best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, term) <= 20)"""


def sentiment_sql() -> str:
    boost = " + ".join(
        f"coalesce(sign(valence) * b{i}.delta * {decay}, 0)" for i, decay in enumerate(settings.BOOST_DECAY, 1)
    )
    joins = " ".join(f"LEFT JOIN boosters b{i} ON b{i}.word = p{i}" for i in (1, 2, 3))
    turned = " OR ".join(f"coalesce(p{i} IN {texts(tables.NEGATIONS)}, false)" for i in (1, 2, 3))
    lags = ", ".join(f"lag(token, {i}) OVER (PARTITION BY doc_id ORDER BY pos) AS p{i}" for i in (1, 2, 3))
    return f"""WITH lexicon(word, valence) AS (VALUES {rows(tables.LEXICON.items())}),
boosters(word, delta) AS (VALUES {rows(tables.BOOSTERS.items())}),
lists AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+') AS t FROM documents),
tokens AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM lists),
near AS (SELECT doc_id, token, {lags} FROM tokens),
valued AS (
  SELECT doc_id, coalesce((valence + {boost}) * CASE WHEN {turned} THEN {settings.NEGATION_FACTOR} ELSE 1 END, 0) AS v
  FROM near LEFT JOIN lexicon ON lexicon.word = token {joins}),
sums AS (
  SELECT doc_id, sum(v) AS s, coalesce(sum(v + 1) FILTER (v > 0), 0) AS up, coalesce(sum(1 - v) FILTER (v < 0), 0) AS down,
         count(*) FILTER (v = 0) AS zero FROM valued GROUP BY doc_id),
scores AS (
  SELECT d.doc_id AS review_id, coalesce({rnd('s / sqrt(s * s + 15)', 4)}, 0) AS sentiment_compound,
         coalesce({rnd('up / (up + down + zero)', 4)}, 0) AS sentiment_positive,
         coalesce({rnd('zero / (up + down + zero)', 4)}, 1) AS sentiment_neutral,
         coalesce({rnd('down / (up + down + zero)', 4)}, 0) AS sentiment_negative
  FROM documents d LEFT JOIN sums ON d.doc_id = sums.doc_id)
SELECT *, CASE WHEN sentiment_compound >= 0.05 THEN 'Positive' WHEN sentiment_compound <= -0.05 THEN 'Negative'
               ELSE 'Neutral' END AS sentiment_label FROM scores"""


LEARNT = f"""lexicon AS (SELECT token AS word, valence FROM (
  SELECT token, {rnd("4.0::DOUBLE * (count(*) FILTER (label = 'Positive') - count(*) FILTER (label = 'Negative')) / count(*)", 3)} AS valence
  FROM (SELECT DISTINCT review_id, sentiment_label AS label, unnest(regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}_'']+')) AS token
        FROM text_reviews WHERE sentiment_label IN ('Positive', 'Negative'))
  GROUP BY token HAVING count(*) >= 5) WHERE valence <> 0)"""


def written_sql(lexicon: str) -> str:
    """Scores of the loud documents where capitals, marks and pivots count."""
    rules = Rules(pivots=tables.PIVOTS)

    def loud(word: str) -> str:
        return f"CASE WHEN mixed AND upper({word}) = {word} AND lower({word}) <> {word} AND NOT contains({word}, 'ß') THEN {rules.capitals}::DOUBLE ELSE 0 END"

    moved = " + ".join(
        [loud("near.word")] + [f"coalesce((b{i}.delta + {loud(f'p{i}')}) * {decay}::DOUBLE, 0)" for i, decay in enumerate(settings.BOOST_DECAY, 1)]
    )
    joins = " ".join(f"LEFT JOIN boosters b{i} ON b{i}.word = lower(p{i})" for i in (1, 2, 3))
    turned = " OR ".join(f"coalesce(lower(p{i}) IN {texts(tables.NEGATIONS)}, false)" for i in (1, 2, 3))
    lags = ", ".join(f"lag(word, {i}) OVER (PARTITION BY review_id ORDER BY pos) AS p{i}" for i in (1, 2, 3))
    value = f"""(valence + sign(valence) * ({moved})) * CASE WHEN {turned} THEN {settings.NEGATION_FACTOR} ELSE 1 END
       * CASE WHEN pos < turn THEN {rules.before} WHEN pos > turn THEN {rules.after} ELSE 1 END"""
    return of_text(
        f"""SELECT *, CASE WHEN sentiment_compound >= 0.05 THEN 'Positive' WHEN sentiment_compound <= -0.05 THEN 'Negative'
               ELSE 'Neutral' END AS sentiment_label FROM (
  SELECT review_id, coalesce({rnd('total / sqrt(total * total + 15)', 4)}, 0) AS sentiment_compound,
         coalesce({rnd('up / (up + down + zero)', 4)}, 0) AS sentiment_positive,
         coalesce({rnd('zero / (up + down + zero)', 4)}, 1) AS sentiment_neutral,
         coalesce({rnd('down / (up + down + zero)', 4)}, 0) AS sentiment_negative
  FROM (SELECT review_id, zero, s + sign(s) * marks AS total, CASE WHEN up > down THEN up + marks ELSE up END AS up,
               CASE WHEN down > up THEN down + marks ELSE down END AS down FROM loud LEFT JOIN sums USING (review_id)))""",
        lexicon,
        f"boosters(word, delta) AS (VALUES {rows(tables.BOOSTERS.items())})",
        f"""lengths AS (SELECT review_id, review_text AS text, length(review_text) AS n FROM text_reviews)""",
        f"""loud AS (SELECT review_id, text, least(length(text) - length(replace(text, '!', '')), 4) * {rules.exclamation}::DOUBLE
           + CASE WHEN asked < 2 THEN 0 WHEN asked <= 3 THEN asked * {rules.question}::DOUBLE ELSE {rules.questions}::DOUBLE END AS marks
         FROM (SELECT *, length(text) - length(replace(text, '?', '')) AS asked FROM (
           SELECT review_id, CASE WHEN n % 3 = 0 THEN replace(replace(text, ' the ', ' THE '), ' in ', ' IN ')
             WHEN n % 11 = 0 THEN translate(text, {q(tables.SMALL)}, {q(tables.SMALL.upper())}) ELSE text END
             || repeat('!', n % 7) || repeat('?', n % 5) AS text FROM lengths)))""",
        "lists AS (SELECT review_id, regexp_extract_all(text, '[\\p{L}\\p{N}_'']+') AS t FROM loud)",
        "tokens AS (SELECT review_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM lists)",
        f"""facts AS (SELECT review_id, min(pos) FILTER (lower(word) IN {texts(tables.PIVOTS)}) AS turn,
         bool_or(shouted) AND bool_or(NOT shouted) AS mixed FROM (
           SELECT *, upper(word) = word AND lower(word) <> word AND NOT contains(word, 'ß') AS shouted FROM tokens) GROUP BY review_id)""",
        f"near AS (SELECT review_id, word, pos, {lags} FROM tokens)",
        f"""valued AS (SELECT review_id, coalesce(round({value} * 1e9) / 1e9, 0) AS v FROM near JOIN facts USING (review_id)
         LEFT JOIN lexicon ON lexicon.word = lower(near.word) AND lower(near.word) NOT IN {texts(tables.BOOSTERS)} {joins})""",
        """sums AS (SELECT review_id, sum(v) AS s, coalesce(sum(v + 1) FILTER (v > 0), 0) AS up,
         coalesce(sum(1 - v) FILTER (v < 0), 0) AS down, count(*) FILTER (v = 0) AS zero FROM valued GROUP BY review_id)""",
    )


def all_oracles() -> dict[str, str]:
    month_filter = "WHERE review_year IS NOT NULL AND review_month IS NOT NULL GROUP BY review_year, review_month"
    built_business = f"""SELECT {BUSINESS_KEY} AS business_id, CAST(p_partkey AS VARCHAR) AS external_id, name,
        sha256(city) AS city_id, sha256(category) AS category_id, CAST(p_size AS DOUBLE) AS latitude, 'google_maps' AS source
        FROM (SELECT DISTINCT name, city, category, p_size, p_partkey FROM rows)
        QUALIFY row_number() OVER (PARTITION BY name, city ORDER BY p_partkey) = 1"""
    day = "CAST(o_orderdate AS DATE)"
    return {
        "kpi_summary": star(
            f"""SELECT count(*) AS total_reviews, {avg(2)} AS avg_rating, {pct('Positive', 1)} AS positive_pct,
            {pct('Negative', 1)} AS negative_pct, {pct('Neutral', 1)} AS neutral_pct,
            (SELECT count(*) FROM businesses) AS total_businesses, (SELECT count(*) FROM cities) AS total_cities
            FROM reviews r"""
        ),
        "rating_distribution": star(
            f"""SELECT CAST(trunc(rating) AS BIGINT) AS rating, count(*) AS review_count,
            {rnd('100.0::DOUBLE * count(*) / (SELECT count(*) FROM reviews)', 2)} AS pct
            FROM reviews WHERE rating BETWEEN 1 AND 5 GROUP BY CAST(trunc(rating) AS BIGINT)"""
        ),
        "rating_distribution_raw": star(
            "SELECT CAST(trunc(rating) AS BIGINT) AS rating, count(*) AS review_count FROM reviews GROUP BY 1"
        ),
        "avg_rating_by_city": average_by(CITY, "city_name", "LIMIT 30"),
        "avg_rating_by_city_all": average_by(CITY, "city_name"),
        "avg_rating_by_category": average_by(CATEGORY, "category_name"),
        "top_businesses": listed(
            f", {pct('Positive', 1)} AS positive_pct",
            "ORDER BY avg_rating DESC, review_count DESC, business_name, b.business_id LIMIT 10",
        ),
        "bottom_businesses": listed(
            f", {pct('Negative', 1)} AS negative_pct",
            "ORDER BY avg_rating, negative_pct DESC, business_name, b.business_id LIMIT 10",
        ),
        "top_businesses_with_city": with_city("DESC"),
        "bottom_businesses_with_city": with_city("ASC"),
        "needs_attention": listed(
            f", {pct('Negative', 1)} AS negative_pct", "", f"AND {avg(2)} < {tables.ATTENTION}"
        ),
        "monthly_volume": star(
            f"""SELECT review_year AS year, review_month AS month, {YM} AS year_month, count(*) AS review_count
            FROM reviews r {month_filter}"""
        ),
        "monthly_volume_year_only": star(
            """SELECT review_year, review_month, count(*) AS review_count FROM reviews
            WHERE review_year IS NOT NULL GROUP BY review_year, review_month"""
        ),
        "monthly_avg_rating": star(
            f"""SELECT review_year AS year, review_month AS month, {YM} AS year_month, {avg(3)} AS avg_rating,
            count(*) AS review_count FROM reviews r {month_filter}"""
        ),
        "monthly_sentiment": star(
            f"""SELECT review_year, review_month, {YM} AS year_month, count(*) AS total, {pct('Positive', 2)} AS positive_pct,
            {pct('Negative', 2)} AS negative_pct, {pct('Neutral', 2)} AS neutral_pct FROM reviews r {month_filter}"""
        ),
        "city_performance": performance(CITY, "city_name"),
        "category_performance": performance(CATEGORY, "category_name"),
        "category_volume": star(
            f"""SELECT category_name, {avg(2)} AS avg_rating, count(*) AS review_count FROM {CATEGORY} GROUP BY category_name
            HAVING count(*) >= {MIN} ORDER BY review_count DESC, category_name LIMIT 4"""
        ),
        "overall_avg": star(f"SELECT {avg(3)} AS national_avg FROM reviews r"),
        "positive_share_by_category": star(
            f"""SELECT category_name, {pct('Positive', None)} AS pos_pct FROM {CATEGORY} GROUP BY category_name
            HAVING count(*) >= 10"""
        ),
        "business_profile": star(f"SELECT * FROM profile WHERE name = {q(tables.NAMES[0])}", PROFILE),
        "business_profile_trend": star(
            f"""SELECT {YM} AS year_month, {avg(2)} AS avg_rating, count(*) AS review_count FROM {CHAIN}
            WHERE b.name = {q(tables.NAMES[0])} AND review_year IS NOT NULL GROUP BY review_year, review_month"""
        ),
        "business_comparison": star(
            f"""SELECT name, {rnd('avg_rating / 5 * 100', 9)} AS rating_score, positive_pct AS positive_score,
            {rnd('review_count / greatest((SELECT max(review_count) FROM profile), 1) * 100', 9)} AS volume_score,
            {rnd('100 - negative_pct', 9)} AS negative_free_score,
            {rnd('least(review_count / 50, 100)', 9)} AS engagement_score FROM profile""",
            PROFILE,
        ),
        "rating_gap": star(
            f"""SELECT a.avg_rating AS first_avg, b.avg_rating AS second_avg, a.review_count AS first_reviews,
            b.review_count AS second_reviews, {rnd('a.avg_rating - b.avg_rating', 2)} AS rating_gap
            FROM profile a, profile b WHERE a.name = {q(tables.NAMES[0])} AND b.name = {q(tables.NAMES[1])}""",
            PROFILE,
        ),
        "sentiment_breakdown": star(
            """SELECT name, 'Positive' AS sentiment, positive_pct AS pct FROM profile
            UNION ALL SELECT name, 'Neutral', neutral_pct FROM profile
            UNION ALL SELECT name, 'Negative', negative_pct FROM profile""",
            PROFILE,
        ),
        "rating_bands": star(
            f"""SELECT CASE WHEN a < 2 THEN 'low' WHEN a < 3.5 THEN 'medium' ELSE 'high' END AS band, count(*) AS businesses
            FROM (SELECT {avg(2)} AS a FROM reviews r GROUP BY business_id) GROUP BY 1"""
        ),
        "sentiment_counts": star(
            f"""SELECT sentiment_label, count(*) AS count,
            {rnd('100.0::DOUBLE * count(*) / (SELECT count(*) FROM reviews)', 2)} AS pct FROM reviews GROUP BY sentiment_label"""
        ),
        "sentiment_share_labelled": star(
            f"""SELECT sentiment_label, count(*) AS count,
            {rnd('100.0::DOUBLE * count(*) / (SELECT count(sentiment_label) FROM reviews)', 9)} AS pct
            FROM reviews WHERE sentiment_label IS NOT NULL GROUP BY sentiment_label"""
        ),
        "label_shares": star(
            f"""SELECT {pct('Positive', 1)} AS positive_pct, {pct('Neutral', 1)} AS neutral_pct,
            {pct('Negative', 1)} AS negative_pct FROM reviews r"""
        ),
        "above_city_average": star(
            f"""SELECT b.business_id, b.name, c.city_name, {avg(2)} AS b_avg FROM {CITY}
            JOIN (SELECT b2.city_id, avg(r2.rating) AS city_avg FROM reviews r2 JOIN businesses b2
                  ON r2.business_id = b2.business_id GROUP BY b2.city_id) m ON m.city_id = b.city_id
            GROUP BY b.business_id, b.name, c.city_name, city_avg HAVING avg(r.rating) > city_avg"""
        ),
        "view_business_summary": star(
            f"""SELECT b.business_id, b.name, c.city_name, g.category_name, count(r.review_id) AS total_reviews,
            {avg(2)} AS average_rating,
            CAST(sum(CASE WHEN r.sentiment_label = 'Positive' THEN 1 ELSE 0 END) AS BIGINT) AS positive_reviews,
            CAST(sum(CASE WHEN r.sentiment_label = 'Negative' THEN 1 ELSE 0 END) AS BIGINT) AS negative_reviews,
            {pct('Positive', 2, 'count(r.review_id)')} AS positive_pct
            FROM businesses b LEFT JOIN reviews r ON b.business_id = r.business_id LEFT JOIN cities c ON b.city_id = c.city_id
            LEFT JOIN categories g ON b.category_id = g.category_id
            GROUP BY b.business_id, b.name, c.city_name, g.category_name"""
        ),
        "view_city_summary": star(
            f"""SELECT c.city_name, count(DISTINCT b.business_id) AS total_businesses, count(r.review_id) AS total_reviews,
            {avg(2)} AS average_rating, {pct('Positive', 2, 'count(r.review_id)')} AS positive_pct
            FROM cities c LEFT JOIN businesses b ON c.city_id = b.city_id LEFT JOIN reviews r ON b.business_id = r.business_id
            GROUP BY c.city_id, c.city_name"""
        ),
        "view_monthly_trends": star(
            f"""SELECT review_year, review_month, {YM} AS year_month, count(*) AS total_reviews, {avg(2)} AS average_rating,
            {pct('Positive', 2)} AS positive_pct, {pct('Negative', 2)} AS negative_pct FROM reviews r {month_filter}"""
        ),
        "city_map": star(
            f"""SELECT c.city_name, latitude, longitude, {avg(2)} AS avg_rating, count(*) AS review_count FROM {CITY}
            WHERE latitude IS NOT NULL GROUP BY c.city_name, latitude, longitude"""
        ),
        "growth_rate": star(
            f"""SELECT year_month, review_count, lag(review_count) OVER (ORDER BY year_month) AS prev_month_count,
            {rnd('100.0::DOUBLE * (review_count - lag(review_count) OVER (ORDER BY year_month)) / nullif(lag(review_count) OVER (ORDER BY year_month), 0)', 2)}
            AS growth_pct FROM months""",
            MONTHS,
        ),
        "running_avg_rounded": star(
            f"""SELECT year_month, avg3 AS avg_rating,
            {rnd('avg(avg3) OVER (ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 3)} AS running_avg_3m
            FROM months""",
            MONTHS,
        ),
        "running_avg_raw": star(
            f"""SELECT year_month, {rnd('avg_raw', 9)} AS avg_rating,
            {rnd('avg(avg_raw) OVER (ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 9)} AS running_avg_3m
            FROM months""",
            MONTHS,
        ),
        "business_rank": star(
            f"""SELECT *, CAST(dense_rank() OVER (ORDER BY avg_rating DESC) AS BIGINT) AS rating_rank FROM (
            SELECT b.business_id, b.name AS business_name, c.city_name, {avg(2)} AS avg_rating, count(*) AS review_count
            FROM {WIDE} GROUP BY b.business_id, b.name, c.city_name HAVING count(*) >= {MIN})"""
        ),
        "rank_in_city": star(
            f"""SELECT b.business_id, c.city_name, b.name, {avg(2)} AS avg_rating,
            CAST(rank() OVER (PARTITION BY c.city_id ORDER BY avg(r.rating) DESC) AS BIGINT) AS city_rank
            FROM {CITY} GROUP BY b.business_id, c.city_id, c.city_name, b.name HAVING count(*) >= {MIN}"""
        ),
        "city_quartile_asc": star(
            "SELECT *, CAST(ntile(4) OVER (ORDER BY review_count, city_name) AS BIGINT) AS quartile FROM per_city", PER_CITY
        ),
        "city_quartile_desc": star(
            "SELECT *, CAST(ntile(4) OVER (ORDER BY review_count DESC, city_name) AS BIGINT) AS quartile FROM per_city",
            PER_CITY,
        ),
        "best_city_per_category": star(
            f"""SELECT *, CAST(rank() OVER (PARTITION BY category_name ORDER BY avg_rating DESC) AS BIGINT) AS rnk FROM (
            SELECT g.category_name, c.city_name, {avg(2)} AS avg_rating, count(*) AS review_count
            FROM {CATEGORY} JOIN cities c ON b.city_id = c.city_id GROUP BY g.category_name, c.city_name
            HAVING count(*) >= {MIN}) QUALIFY rnk = 1"""
        ),
        "declining_rounded": declining(MIN, 2, "LIMIT 20"),
        "declining_raw": declining(10, None, ""),
        "volume_change": star(
            f"""SELECT {rnd('recent', 9)} AS recent, {rnd('earlier', 9)} AS earlier, months,
            {rnd('100.0::DOUBLE * (recent - earlier) / earlier', 9)} AS change_pct FROM (
            SELECT avg(review_count) FILTER (late <= 3) AS recent, avg(review_count) FILTER (early <= 3) AS earlier,
                   count(*) AS months FROM (
              SELECT *, row_number() OVER (ORDER BY year_month) AS early,
                     row_number() OVER (ORDER BY year_month DESC) AS late FROM months)) WHERE months >= 3""",
            MONTHS,
        ),
        "business_names": star("SELECT DISTINCT name FROM businesses"),
        "city_names": star("SELECT city_name FROM cities"),
        "category_names": star("SELECT category_name FROM categories"),
        "null_summary": null_summary(),
        "value_frequency": star(
            f"""SELECT CAST(review_date AS VARCHAR) AS value, count(*) AS count,
            {rnd('100.0::DOUBLE * count(*) / (SELECT count(*) FROM reviews)', 2)} AS pct FROM reviews GROUP BY review_date
            ORDER BY count DESC, value NULLS FIRST LIMIT 20"""
        ),
        "duplicate_rows": """SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) AS BIGINT)
            AS duplicate_rows FROM documents""",
        "profile_overview": """SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns,
            CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT)
            AS duplicate_rows FROM lineitem""",
        "scored_counts": star(
            "SELECT count(*) AS total_reviews, count(sentiment_label) AS scored_reviews FROM reviews"
        ),
        "clean_pages": f"SELECT page_id, {normalised('html')} AS review_text FROM pages WHERE {SHOWN.replace('text', 'html', 1)}",
        "clean_reviews": f"""WITH {RAW}, kept AS (SELECT DISTINCT * FROM raw WHERE {VALID} AND {SHOWN})
            SELECT CAST(stars AS DOUBLE) AS stars, {normalised('text')} AS text, name, {city('city')} AS city,
            {DAY} AS date, coalesce(visit_details, 'Unknown') AS visit_details FROM kept""",
        "cleaning_metrics": f"""WITH {RAW}, d AS (SELECT *, count(*) AS n FROM raw GROUP BY ALL),
            c AS (SELECT CAST(sum(n) AS BIGINT) AS initial_rows, count(*) AS distinct_rows, count(*) FILTER ({VALID}) AS valid,
              count(*) FILTER ({VALID} AND {SHOWN}) AS final_rows,
              count(*) FILTER ({VALID} AND {SHOWN} AND {DAY} IS NULL) AS null_dates,
              count(DISTINCT city) FILTER ({VALID} AND {SHOWN}) AS cities_before,
              count(DISTINCT {city('city')}) FILTER ({VALID} AND {SHOWN}) AS cities_after,
              count(*) FILTER ({VALID} AND {SHOWN} AND name IS NULL) AS filled_name,
              count(*) FILTER ({VALID} AND {SHOWN} AND visit_details IS NULL) AS filled_visit_details FROM d)
            SELECT initial_rows, initial_rows - distinct_rows AS duplicates_removed,
            distinct_rows - valid AS invalid_ratings_removed, valid - final_rows AS blank_reviews_removed, final_rows,
            initial_rows - final_rows AS total_rows_removed,
            {rnd('100.0::DOUBLE * final_rows / initial_rows', 2)} AS retention_pct, null_dates, cities_before, cities_after,
            filled_name, filled_visit_details FROM c""",
        "standardise_city": f"""WITH names AS (
            SELECT n_name AS city FROM nation
            UNION SELECT ' ' || lower(c_mktsegment) || '''s ' || c_name FROM customer
            UNION SELECT p_name || '-' || p_type FROM part
            UNION SELECT text FROM documents
            UNION SELECT CASE event_type WHEN 'view' THEN 'Bombay' WHEN 'click' THEN ' nyc' || chr(9) WHEN 'purchase' THEN ' ' END
            FROM events) SELECT city, {city('city')} AS standard_city FROM names""",
        "parse_dates": f"""SELECT o_orderkey, {day} AS iso_date, {day} AS us_date, {day} AS written_date, {day} AS zoned_date,
            {day} AS s_date, {day} AS ms_date, CAST(NULL AS DATE) AS none_date,
            CASE WHEN o_orderkey % 5 < 3 THEN {day} END AS mixed_date FROM orders""",
        "build_cities": f"""WITH {CANONICAL} SELECT DISTINCT sha256(city) AS city_id, city AS city_name FROM rows
            WHERE city IS NOT NULL""",
        "build_categories": f"""WITH {CANONICAL} SELECT DISTINCT sha256(category) AS category_id, category AS category_name
            FROM rows WHERE category IS NOT NULL""",
        "build_businesses": f"WITH {CANONICAL} {built_business}",
        "build_reviews": f"""WITH {CANONICAL} SELECT review_id, {BUSINESS_KEY} AS business_id, rating, day AS review_date,
            CAST(year(day) AS BIGINT) AS review_year, CAST(month(day) AS BIGINT) AS review_month, 'google_maps' AS source
            FROM rows""",
        "word_frequency": of_text(
            f"""SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS3}) AS word FROM text_reviews) GROUP BY word
            ORDER BY freq DESC, word LIMIT {settings.WORD_LIST_SIZE}"""
        ),
        "word_frequency_by_label": of_text(
            f"""SELECT sentiment, word, count(*) AS freq FROM (SELECT sentiment_label AS sentiment, unnest({WORDS3}) AS word
            FROM text_reviews WHERE sentiment_label IN ('Positive', 'Negative')) GROUP BY sentiment, word
            QUALIFY row_number() OVER (PARTITION BY sentiment ORDER BY count(*) DESC, word) <= {settings.WORD_LIST_SIZE}"""
        ),
        "theme_counts": of_text(
            f"""SELECT theme, word, count(*) AS mentions, count(DISTINCT review_id) AS reviews FROM (
            SELECT review_id, unnest(regexp_extract_all(lower(review_text), '{WORD}+')) AS word FROM text_reviews)
            JOIN (VALUES {rows([('positive', w) for w in tables.POSITIVE_WORDS] + [('negative', w) for w in tables.NEGATIVE_WORDS])})
            AS themes(theme, word) USING (word) GROUP BY theme, word"""
        ),
        "complaint_tags": of_text(
            """SELECT t.review_id, coalesce(string_agg(category, '|' ORDER BY pos), '') AS complaint_categories
            FROM text_reviews t LEFT JOIN mentions m ON t.review_id = m.review_id GROUP BY t.review_id""",
            mentions(""),
        ),
        "complaint_frequency": of_text(
            f"""SELECT category, count(*) AS count,
            {rnd('100.0::DOUBLE * count(*) / (SELECT count(*) FROM mentions)', 2)} AS pct FROM mentions GROUP BY category""",
            mentions(),
        ),
        "complaint_frequency_all": of_text(
            f"""SELECT category, count(*) AS count,
            {rnd('100.0::DOUBLE * count(*) / (SELECT count(*) FROM mentions)', 2)} AS pct FROM mentions GROUP BY category""",
            mentions(""),
        ),
        "busiest_businesses": of_text(
            """SELECT business_name, count(*) AS count FROM text_reviews WHERE sentiment_label = 'Negative'
            GROUP BY business_name ORDER BY count DESC, business_name LIMIT 5"""
        ),
        "business_complaints": of_text(
            """SELECT business_name AS business, category, count(*) AS count FROM mentions WHERE business_name IN (
              SELECT business_name FROM text_reviews WHERE sentiment_label = 'Negative' GROUP BY business_name
              ORDER BY count(*) DESC, business_name LIMIT 5) GROUP BY business_name, category""",
            mentions(),
        ),
        "phrase_mentions": f"""WITH runs AS (
              SELECT 'd' || doc_id AS of, doc_id AS review_id, NULL AS category, regexp_extract_all(lower(text), '{WORD}+|{NOT_WORD}+') AS t FROM documents
              UNION ALL SELECT 'i' || item_id, NULL, 'topic ' || item_id % 7, regexp_extract_all(lower(text), '{WORD}+|{NOT_WORD}+') FROM benchmark),
            run AS (SELECT of, review_id, category, unnest(t) AS run, generate_subscripts(t, 1) AS pos FROM runs),
            near AS (SELECT *, lead(run, 1) OVER w AS gap, lead(run, 2) OVER w AS next FROM run WINDOW w AS (PARTITION BY of ORDER BY pos)),
            stretches AS (
              SELECT DISTINCT review_id, category, unnest([run, run || gap || next]) AS stretch FROM near WHERE regexp_matches(run, '^{WORD}')),
            phrases AS (SELECT DISTINCT category, stretch FROM stretches WHERE category IS NOT NULL AND (regexp_matches(stretch, '{NOT_WORD}') OR length(stretch) > 8))
            SELECT DISTINCT d.review_id, p.category FROM stretches d JOIN phrases p ON d.stretch = p.stretch WHERE d.review_id IS NOT NULL""",
        "keyword_rows": of_text(
            """SELECT sha256(CAST(review_id AS VARCHAR) || chr(31) || category) AS keyword_id,
            CAST(review_id AS VARCHAR) AS review_id, category AS keyword, category AS complaint_category FROM mentions""",
            mentions(),
        ),
        "top_complaints": of_text(
            f"""SELECT category, count(*) AS count,
            {rnd('100.0::DOUBLE * count(*) / (SELECT count(*) FROM mentions)', 9)} AS pct FROM mentions GROUP BY category""",
            mentions(),
        ),
        "tfidf_keywords": of_text(
            f"SELECT term AS keyword, {rnd('score', 6)} AS tfidf_score FROM best", weighted("'all'")
        ),
        "themes_by_label": of_text(
            f"SELECT term AS keyword, {rnd('score', 6)} AS tfidf_score, grp AS sentiment FROM best",
            weighted("sentiment_label", "WHERE sentiment_label IN ('Positive', 'Negative')"),
        ),
        "sentiment_scores": sentiment_sql(),
        "sentiment_as_written": written_sql(f"lexicon(word, valence) AS (VALUES {rows(tables.LEXICON.items())})"),
        "sentiment_with_lexicon": written_sql(LEARNT),
        "learnt_lexicon": of_text("SELECT word AS token, valence FROM lexicon", LEARNT),
        "attached_scores": """SELECT d.doc_id AS review_id, d.source AS business_name,
            CAST(quality - toxic AS DOUBLE) AS sentiment_compound, CAST(quality AS DOUBLE) AS sentiment_positive,
            CASE WHEN l.doc_id IS NOT NULL THEN 0.0::DOUBLE END AS sentiment_neutral, CAST(toxic AS DOUBLE) AS sentiment_negative,
            CASE WHEN quality > toxic THEN 'Positive' WHEN quality < toxic THEN 'Negative' WHEN quality = toxic THEN 'Neutral' END
            AS sentiment_label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
        "platform_union": """SELECT 'google_maps' AS source, CAST(l_quantity AS DOUBLE) AS rating, l_returnflag AS review_text,
            CAST(NULL AS VARCHAR) AS business_name, l_linestatus AS city, CAST(l_partkey AS VARCHAR) AS business_id FROM lineitem
            UNION ALL SELECT 'yelp', CAST(doc_id % 5 + 1 AS DOUBLE), text, source, lang, CAST(NULL AS VARCHAR) FROM documents""",
        "sql_with_params": """SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber >= 3
            GROUP BY l_returnflag""",
        "insights": insights_sql(),
        "insights_by_source": insights_sql("r.source", line_mentions("r.source")),
        "insights_by_month": insights_sql(MONTH, line_mentions(MONTH)),
        "recommendations": f"SELECT scope, rule_order, action FROM ({insights_sql()})",
        "sample_exact": "SELECT * FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42') LIMIT 500",
        "sample_reviews": star(
            """SELECT b.name AS business_name, c.city_name, r.rating, r.sentiment_label,
            CAST(NULL AS VARCHAR) AS review_text, r.review_date FROM reviews r
            JOIN businesses b ON r.business_id = b.business_id JOIN cities c ON b.city_id = c.city_id
            WHERE r.sentiment_label = 'Negative' AND c.city_name = 'Brand#7' ORDER BY md5(review_id || ':7') LIMIT 20"""
        ),
    }
