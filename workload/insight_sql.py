"""The findings in SQL, phrased in full."""

from __future__ import annotations

from workload import tables
from workload.sqltext import CATEGORY, CHAIN, CITY, MIN, REVIEWS, TEXT_REVIEWS, YM, avg, mentions, pct, rnd


def fmt(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', {rnd(value, digits)})"


#: (scope, category) of the documents' complaints, and of the line items' by an expression over the reviews.
DOCUMENT_MENTIONS = "SELECT 'all' AS scope, category FROM mentions"


def line_mentions(scope: str) -> str:
    return f"""SELECT {scope} AS scope, CASE WHEN r.rating <= 2 THEN 'Service' WHEN r.rating = 3 THEN 'Waiting Time'
        ELSE 'Price / Value' END AS category FROM reviews r WHERE r.sentiment_label = 'Negative'"""


MONTH = f"CASE WHEN r.review_year IS NOT NULL THEN {YM} ELSE 'undated' END"


def insights_sql(scope: str = "'all'", complaints: str = DOCUMENT_MENTIONS) -> str:
    """All findings per value of ``scope``, an expression over the reviews; ``complaints`` selects (scope, category)."""

    def per(key: str, joined: str) -> str:
        return (
            f"SELECT {scope} AS scope, {key} AS name, {avg(2)} AS a, count(*) AS n FROM {joined} "
            f"GROUP BY ALL HAVING count(*) >= {MIN}"
        )

    ctes = [
        f"""kpi AS (SELECT {scope} AS scope, {pct('Positive', 1)} AS p, {pct('Negative', 1)} AS n, {avg(2)} AS a2,
            {avg(3)} AS a3 FROM reviews r GROUP BY ALL)""",
        f"""low AS (SELECT {scope} AS scope, r.business_id AS id, b.name AS name, {avg(2)} AS a, count(*) AS n FROM {CHAIN}
            GROUP BY ALL HAVING count(*) >= {MIN} AND {avg(2)} < {tables.ATTENTION})""",
        """worst AS (SELECT *, count(*) OVER (PARTITION BY scope) AS k FROM low
            QUALIFY row_number() OVER (PARTITION BY scope ORDER BY a, name, id) = 1)""",
        f"per_city AS ({per('c.city_name', CITY)})",
        """sides AS (SELECT per_city.*, a3, CASE WHEN a < a3 - 0.3 THEN 'low' WHEN a > a3 + 0.3 THEN 'high' END AS side
            FROM per_city JOIN kpi ON per_city.scope = kpi.scope WHERE a3 <> 0)""",
        """gaps AS (SELECT scope, side, string_agg(name, ', ' ORDER BY n DESC, name) AS names, count(*) AS k, avg(a) AS m,
            max(a3) AS a3 FROM (SELECT * FROM sides WHERE side IS NOT NULL
                                QUALIFY row_number() OVER (PARTITION BY scope, side ORDER BY n DESC, name) <= 3)
            GROUP BY scope, side)""",
        f"per_category AS ({per('g.category_name', CATEGORY)})",
        """ends AS (SELECT scope, first(name ORDER BY a DESC, name) AS best, last(name ORDER BY a DESC, name) AS worst,
            max(a) AS hi, min(a) AS lo, count(*) AS k FROM per_category GROUP BY scope)""",
        f"""months AS (SELECT {scope} AS scope, {YM} AS ym, count(*) AS n FROM reviews r
            WHERE review_year IS NOT NULL AND review_month IS NOT NULL GROUP BY ALL)""",
        """trend AS (SELECT scope, 100 * (avg(n) FILTER (late <= 3) - avg(n) FILTER (early <= 3))
            / avg(n) FILTER (early <= 3) AS change
            FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ym) AS early,
                  row_number() OVER (PARTITION BY scope ORDER BY ym DESC) AS late FROM months)
            GROUP BY scope HAVING count(*) >= 3)""",
    ]
    findings = [
        f"""SELECT scope, CAST(1 AS BIGINT) AS rule_order, 'success' AS type, 'Strong Positive Sentiment' AS title,
        {fmt('p', 1)} || '% of reviews are positive, indicating generally satisfied customers with an average rating of '
        || {fmt('a2', 2)} || '★.' AS detail,
        'Maintain quality standards and leverage positive reviews in marketing.' AS action FROM kpi WHERE p >= 70""",
        f"""SELECT scope, 1, 'critical', 'High Negative Sentiment Alert', {fmt('n', 1)} ||
        '% of reviews are negative. This level of negative sentiment requires immediate management attention.',
        'Initiate customer recovery program. Respond to all negative reviews within 24 hours.'
        FROM kpi WHERE p < 70 AND n >= 30""",
        f"""SELECT scope, 1, 'warning', 'Elevated Negative Feedback', {fmt('n', 1)} ||
        '% of all reviews are negative. Overall average rating is ' || {fmt('a2', 2)} || '★.',
        'Review complaint categories and develop targeted action plans.' FROM kpi WHERE p < 70 AND n >= 20 AND n < 30""",
        f"""SELECT scope, 2, CASE WHEN k > 5 THEN 'critical' ELSE 'warning' END,
        k || ' Business' || CASE WHEN k > 1 THEN 'es' ELSE '' END || ' Need Attention',
        k || ' businesses have an average rating below {tables.ATTENTION}★. The lowest-rated is ''' || name || ''' ('
        || {fmt('a', 1)} || '★ across ' || n || ' reviews).',
        'Conduct service quality audits for these locations. Review negative feedback themes to identify root causes.'
        FROM worst""",
        f"""SELECT scope, 3, 'warning', 'Cities Below National Average',
        names || CASE WHEN k > 1 THEN ' have' ELSE ' has' END || ' average ratings (' || {fmt('m', 2)} ||
        '★) significantly below the national average of ' || {fmt('a3', 2)} || '★.',
        'Investigate location-specific factors such as local competition, staffing issues, or regional customer expectations.'
        FROM gaps WHERE side = 'low'""",
        f"""SELECT scope, 4, 'success', 'Top Performing Cities', names || CASE WHEN k > 1 THEN ' are' ELSE ' is' END
        || ' performing above the national average with ratings of ' || {fmt('m', 2)} || '★.',
        'Study best practices from these locations and replicate successful approaches in underperforming cities.'
        FROM gaps WHERE side = 'high'""",
        f"""SELECT scope, 6, 'info', best || ' Outperforms Others',
        '''' || best || ''' category leads with ' || {fmt('hi', 2)} || '★, while ''' || worst || ''' lags at ' ||
        {fmt('lo', 2)} || '★ — a gap of ' || {fmt('hi - lo', 2)} || ' stars.',
        'Investigate what ''' || best ||
        ''' businesses do differently. Consider cross-category training and process sharing.' FROM ends WHERE k >= 2""",
        f"""SELECT scope, 7, 'success', 'Growing Review Volume', 'Recent review volume is ' || {fmt('change', 0)} ||
        '% higher than earlier periods, indicating increased customer engagement.',
        'Capitalise on growth momentum. Encourage reviews through loyalty programs.' FROM trend WHERE change > 20""",
        f"""SELECT scope, 7, 'warning', 'Declining Review Activity', 'Recent review volume has dropped by ' ||
        {fmt('abs(change)', 0)} || '% compared to earlier periods.',
        'Investigate causes of reduced engagement. Consider review solicitation campaigns.' FROM trend WHERE change < -20""",
    ]
    ctes += [TEXT_REVIEWS, mentions(), f"complaints AS ({complaints})"]
    findings.append(
        f"""SELECT scope, 5, 'warning', 'Top Complaint: ' || category,
        '''' || category || ''' accounts for ' || {fmt('100.0::DOUBLE * n / total', 1)} ||
        '% of all negative feedback — the most frequently mentioned issue in customer reviews.',
        'Prioritise improvements to ' || lower(category) || ' experience. Set measurable targets and monitor weekly.'
        FROM (SELECT *, sum(n) OVER (PARTITION BY scope) AS total
              FROM (SELECT scope, category, count(*) AS n FROM complaints GROUP BY scope, category))
        QUALIFY row_number() OVER (PARTITION BY scope ORDER BY n DESC, category) = 1"""
    )
    return "WITH " + ",".join([REVIEWS, *ctes]) + "\n" + "\nUNION ALL ".join(findings)
