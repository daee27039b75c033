"""The catalog's queries in plain SQL, for a second engine to check.

The SQL takes the direct way where the operators take a scalable one: it joins items with
reviews before it sums, ranks with windows over everything, and tests categories one row
set at a time. Named parts are put in front of a query as CTEs when it mentions them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from parecer.functions import fixed_values as fv
from parecer.functions.ladders import Ladder
from parecer.operators.models import FEATURES, PHRASE
from parecer.operators.topic_model import DIGAMMA_SHIFT, FOLD_IN_STEPS
from parecer.plans.catalog import SAMPLE_THEMES, SAMPLE_WORD_THEMES, SAMPLE_WORDS, TOPIC_GROUPS
from parecer.sources.schemas import ROLLUPS, TABLES, TIMESTAMP_COLUMNS
from parecer.sources.star_schema import ADAPTER_SQL


def num(expr: str, digits: int = 6) -> str:
    """Half away from zero at so many digits, as double."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def even(expr: str, digits: int = 1) -> str:
    """Half to even at so many digits, as double."""
    return f"CAST(round_even(round(CAST({expr} AS DOUBLE), 12), {digits}) AS DOUBLE)"


def whole(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def pct(part: str, total: str) -> str:
    return f"CAST({part} AS DOUBLE) * 100 / NULLIF(CAST({total} AS DOUBLE), 0)"


def quoted(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def case(x: str, ladder: Ladder, rank: bool = False) -> str:
    arms = [
        f"WHEN {x} {test} {edge} THEN {i if rank else quoted([name])}"
        for i, (test, edge, name) in enumerate(ladder.steps)
    ]
    other = len(ladder.steps) if rank else quoted([ladder.other])
    return f"CASE {' '.join(arms)} ELSE {other} END"


def cut_case(x: str, edges: Sequence[int], labels: Sequence[str]) -> str:
    arms = [
        f"WHEN {x} > {a} AND {x} <= {b} THEN {quoted([name])}"
        for a, b, name in zip(edges, edges[1:], labels)
    ]
    return f"CASE {' '.join(arms)} END"


def listed(names: Sequence[str], column: str) -> str:
    rows = ", ".join(f"({i}, {quoted([n])})" for i, n in enumerate(names))
    return f"(VALUES {rows}) AS listed(ord, {column})"


def pairs(groups: Mapping[str, Sequence[str]]) -> str:
    rows = [
        f"({i}, {quoted([name])}, {quoted([word])})"
        for i, (name, members) in enumerate(groups.items())
        for word in members
    ]
    return f"(VALUES {', '.join(rows)}) AS lexicon(ord, theme, word)"


_TRUNC = (
    "CAST(trunc((epoch_us(order_delivered_customer_date) - "
    "epoch_us(order_estimated_delivery_date)) / 86400000000.0) AS INT)"
)


def _floor(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS INT)"


_CLEAN = (
    f"coalesce(regexp_replace(regexp_replace(lower(review_comment_message), '{fv.URL_PATTERN}', "
    f"' ', 'g'), '{fv.NON_LETTER_PATTERN}', ' ', 'g'), '')"
)

_THEN = {"bad": "review_score <= 2", "good": "review_score >= 4"}

PARTS: dict[str, str] = {
    **ADAPTER_SQL,
    "delivered_sql": f"""
        SELECT order_id, {_TRUNC} AS delay_days FROM a_orders
        WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
          AND order_estimated_delivery_date IS NOT NULL""",
    "delivered_eda": """
        SELECT *, actual_delivery_days - estimated_delivery_days AS delay_days
        FROM (SELECT order_id, order_purchase_timestamp, """
    + _floor("order_delivered_customer_date", "order_purchase_timestamp")
    + " AS actual_delivery_days, "
    + _floor("order_estimated_delivery_date", "order_purchase_timestamp")
    + """ AS estimated_delivery_days
              FROM a_orders WHERE order_status = 'delivered')""",
    "order_reviews": """
        SELECT order_id, AVG(review_score) AS avg_score, COUNT(*) AS n_reviews
        FROM a_reviews GROUP BY order_id""",
    "order_freight": f"""
        SELECT order_id, SUM(freight_value) AS total_freight, SUM(price) AS total_price,
          {pct("SUM(freight_value)", "SUM(price)")} AS freight_ratio
        FROM a_items GROUP BY order_id""",
    "order_pay": """
        SELECT order_id, MAX(payment_type) AS pay_type,
          MAX(payment_installments) AS installments
        FROM a_payments GROUP BY order_id""",
    "top_pay": """
        SELECT * FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id
            ORDER BY payment_value DESC, payment_type, payment_installments) AS rn
          FROM a_payments) WHERE rn = 1""",
    "item_category": """
        SELECT i.*, c.product_category_name_english AS english, p.product_category_name AS original
        FROM a_items i JOIN a_products p ON i.product_id = p.product_id
        LEFT JOIN a_category_trans c ON p.product_category_name = c.product_category_name""",
    "first_category": """
        SELECT order_id, coalesce(english, 'Unknown') AS category FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id
            ORDER BY product_id, coalesce(english, 'Unknown')) AS rn FROM item_category)
        WHERE rn = 1""",
    "order_facts": f"""
        SELECT o.order_id, any_value(o.delay_days) AS delay_days,
          MAX(CASE WHEN o.delay_days > 0 THEN 1 ELSE 0 END) AS is_delayed,
          MAX(CASE WHEN o.delay_days > 4 THEN 1 ELSE 0 END) AS is_severely_delayed,
          {num("AVG(r.review_score)", 2)} AS avg_score,
          CASE WHEN AVG(r.review_score) <= 2 THEN 1 ELSE 0 END AS is_bad,
          SUM(i.price) AS total_price, SUM(i.freight_value) AS total_freight,
          {pct("SUM(i.freight_value)", "SUM(i.price)")} AS freight_ratio,
          COUNT(DISTINCT i.product_id) AS item_count,
          MAX(p.payment_type) AS pay_type, MAX(p.payment_installments) AS installments,
          MAX(c.category) AS main_category
        FROM delivered_sql o JOIN item_category i ON o.order_id = i.order_id
        JOIN a_reviews r ON o.order_id = r.order_id
        JOIN first_category c ON o.order_id = c.order_id
        LEFT JOIN top_pay p ON o.order_id = p.order_id
        GROUP BY o.order_id""",
    "category_facts": """
        SELECT o.order_id, MAX(CASE WHEN o.delay_days > 0 THEN 1 ELSE 0 END) AS is_delayed,
          CASE WHEN AVG(r.review_score) <= 2 THEN 1 ELSE 0 END AS is_bad,
          MAX(c.category) AS category, SUM(i.price) AS gmv, SUM(i.freight_value) AS freight,
          COUNT(*) AS items
        FROM delivered_sql o JOIN item_category i ON o.order_id = i.order_id
        JOIN a_reviews r ON o.order_id = r.order_id
        JOIN first_category c ON o.order_id = c.order_id
        GROUP BY o.order_id""",
    "category_stats": f"""
        SELECT category, COUNT(*) AS orders, SUM(is_delayed) AS delayed_orders,
          SUM(is_bad) AS bad_orders,
          COUNT(*) FILTER (is_delayed = 1 AND is_bad = 1) AS delayed_bad,
          COUNT(*) FILTER (is_delayed = 0 AND is_bad = 1) AS ontime_bad,
          AVG(is_delayed) * 100 AS delay_rate, AVG(is_bad) * 100 AS bad_rate,
          AVG(is_bad) FILTER (is_delayed = 1) * 100 AS bad_delayed,
          AVG(is_bad) FILTER (is_delayed = 0) * 100 AS bad_ontime,
          SUM(gmv) AS total_gmv, CAST(SUM(gmv) AS DOUBLE) / COUNT(*) AS avg_gmv
        FROM category_facts GROUP BY category""",
    "seller_gmv": """
        SELECT seller_id, COUNT(*) AS n_items, SUM(price) AS gmv FROM a_items
        GROUP BY seller_id""",
    "lorenz": f"""
        SELECT seller_id, gmv, ROW_NUMBER() OVER w AS rank, COUNT(*) OVER () AS n_total,
          {pct("SUM(gmv) OVER (ORDER BY gmv DESC, seller_id ROWS UNBOUNDED PRECEDING)",
               "SUM(gmv) OVER ()")} AS cum_pct
        FROM seller_gmv WINDOW w AS (ORDER BY gmv DESC, seller_id)""",
    "category_gmv": f"""
        SELECT coalesce(english, original) AS category_en, COUNT(order_id) AS n_items,
          SUM(price) AS gmv, CAST(SUM(price) AS DOUBLE) / COUNT(price) AS mean_price,
          SUM(freight_value) AS freight,
          {even(pct("SUM(freight_value)", "SUM(price)"))} AS freight_pct,
          {even("CAST(SUM(freight_value) AS DOUBLE) / COUNT(*)")} AS mean_freight
        FROM item_category WHERE coalesce(english, original) IS NOT NULL
        GROUP BY coalesce(english, original)""",
    "rollup_facts": f"""
        SELECT o.*, strftime(o.order_purchase_timestamp, '%Y-%m') AS purchase_month,
          CASE WHEN o.delay_days > 0 THEN 1 ELSE 0 END AS late, r.avg_score,
          CASE WHEN r.avg_score <= 2 THEN 1 ELSE 0 END AS bad,
          f.total_price AS price, f.freight_ratio,
          coalesce(c.category, 'Unknown') AS category,
          coalesce(p.payment_type, 'unknown') AS pay_type,
          p.payment_installments AS installments, s.paid
        FROM delivered_eda o LEFT JOIN order_reviews r ON o.order_id = r.order_id
        LEFT JOIN order_freight f ON o.order_id = f.order_id
        LEFT JOIN first_category c ON o.order_id = c.order_id
        LEFT JOIN top_pay p ON o.order_id = p.order_id
        LEFT JOIN (SELECT order_id, SUM(payment_value) AS paid FROM a_payments GROUP BY order_id) s
          ON o.order_id = s.order_id""",
    "monthly": f"""
        SELECT purchase_month, COUNT(*) AS "to", {whole("SUM(late)")} AS "do",
          {whole("SUM(bad)")} AS br, {num(pct("SUM(late)", "COUNT(*)"), 1)} AS dr,
          {num(pct("SUM(bad)", "COUNT(*)"), 1)} AS brr, {num("AVG(delay_days)", 1)} AS "add",
          {num("AVG(avg_score)", 2)} AS "asc"
        FROM rollup_facts GROUP BY purchase_month""",
    "dose": f"""
        SELECT {case("delay_days", fv.DOSE_LADDER)} AS delay_bucket, COUNT(*) AS ords,
          {whole("SUM(bad)")} AS bads, {num(pct("SUM(bad)", "COUNT(*)"), 1)} AS brate
        FROM rollup_facts GROUP BY 1""",
    "kpi": " UNION ALL ".join(
        f"SELECT {quoted([metric])} AS metric, {value} AS value, {quoted([fmt])} AS format "
        "FROM rollup_facts"
        for (metric, fmt), value in zip(
            fv.KPI_ROWS,
            (
                "CAST(COUNT(*) AS DOUBLE)",
                num(pct("SUM(bad)", "COUNT(*)"), 1),
                num(pct("SUM(late)", "COUNT(*)"), 1),
                num("AVG(avg_score)", 2),
            ),
        )
    ),
    "group_compare": f"""
        SELECT CASE WHEN bad = 1 THEN {quoted(fv.GROUP_LABELS[:1])}
                    ELSE {quoted(fv.GROUP_LABELS[1:])} END AS rg,
          COUNT(*) AS "to", {num(pct("SUM(late)", "COUNT(*)"), 1)} AS dr,
          {num("AVG(delay_days)", 1)} AS "add",
          {num("CAST(SUM(price) AS DOUBLE) / COUNT(price)", 2)} AS ap,
          {num("AVG(freight_ratio)", 1)} AS afr, {num("AVG(installments)", 1)} AS ai,
          {num("AVG(actual_delivery_days)", 1)} AS aad,
          {num("AVG(estimated_delivery_days)", 1)} AS aed
        FROM rollup_facts GROUP BY 1""",
    "category_risk": f"""
        SELECT category AS product_category_name_english, COUNT(*) AS "to",
          {whole("SUM(late)")} AS "do", {whole("SUM(bad)")} AS br,
          {num(pct("SUM(late)", "COUNT(*)"), 1)} AS dr,
          {num(pct("SUM(bad)", "COUNT(*)"), 1)} AS brr, {num("AVG(delay_days)", 1)} AS "add",
          {num("CAST(SUM(price) AS DOUBLE) / COUNT(price)", 2)} AS ap,
          {num("AVG(freight_ratio)", 1)} AS afr,
          {num("AVG(bad) FILTER (late = 1) * 100", 1)} AS d_br,
          {num("AVG(bad) FILTER (late = 0) * 100", 1)} AS o_br,
          {num("AVG(bad) FILTER (late = 1) / NULLIF(AVG(bad) FILTER (late = 0), 0)", 1)} AS lift
        FROM rollup_facts GROUP BY category HAVING COUNT(*) >= 50""",
    "texts": f"""
        SELECT r.*, {_TRUNC} AS delay_days, {_CLEAN} AS cleaned
        FROM a_text_reviews r JOIN a_orders o ON r.order_id = o.order_id
        WHERE o.order_status = 'delivered' AND r.review_comment_message IS NOT NULL
          AND r.review_comment_message <> ''""",
    "text_words": f"""
        SELECT review_id, review_score, delay_days, word FROM (
          SELECT review_id, review_score, delay_days,
            unnest(string_split(trim(cleaned), ' ')) AS word FROM texts)
        WHERE length(word) > 2 AND word NOT IN ({quoted(fv.STOPWORDS)})""",
    "docs": f"""
        SELECT review_id, delay_days, CASE WHEN delay_days > 0 THEN 1 ELSE 0 END AS is_delayed,
          array_to_string(list_filter(string_split(trim(cleaned), ' '), lambda w:
            length(w) > 2 AND w NOT IN ({quoted(fv.TOPIC_STOPWORDS)})), ' ') AS cleaned_text
        FROM texts WHERE review_score <= 2""",
    "corpus": "SELECT * FROM docs WHERE length(cleaned_text) > 10",
    "corpus_words": """
        SELECT *, list_filter(string_split_regex(cleaned_text, '[ ÷]+'),
          lambda w: length(w) > 1) AS words FROM corpus""",
    "corpus_terms": """
        SELECT review_id, list_concat(words, [words[i] || ' ' || words[i + 1]
          FOR i IN range(1, len(words))]) AS terms FROM corpus_words""",
}


def with_parts(sql: str) -> str:
    """The query with every part it needs in front, each part after those it needs."""
    needed: list[str] = []

    def visit(text: str, above: tuple[str, ...] = ()) -> None:
        for name in PARTS:
            if name in needed or name in above:
                continue
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(PARTS[name], (*above, name))
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in needed) + "\n" + sql


def _time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


def _profile(overrides: Mapping[str, str] | None = None) -> str:
    sources = {
        "orders": "a_orders", "order_items": "a_items", "payments": "a_payments",
        "reviews": "a_reviews", "products": "a_products", "category_trans": "a_category_trans",
        "customers": "a_customers", "sellers": "a_sellers", "geolocation": "a_geolocation",
    }
    sources.update(overrides or {})
    columns = {
        "a_orders": ["order_id", "customer_id", "order_status", *TIMESTAMP_COLUMNS],
        "a_items": ["order_id", "product_id", "seller_id", "price", "freight_value"],
        "a_payments": ["order_id", "payment_type", "payment_installments", "payment_value"],
        "a_reviews": ["order_id", "review_score"],
        "a_products": ["product_id", "product_category_name"],
        "a_category_trans": ["product_category_name", "product_category_name_english"],
        "a_customers": ["customer_id", "customer_zip_code_prefix", "customer_city"],
        "a_sellers": ["seller_id", "seller_zip_code_prefix"],
        "a_geolocation": ["geolocation_zip_code_prefix", "geolocation_state"],
        "a_text_reviews": ["review_id", "order_id", "review_score", "review_comment_message"],
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, COUNT(*) AS n_rows, {len(columns[view])} AS n_cols, "
        + whole(" + ".join(f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in columns[view]))
        + f" AS n_null FROM {view}"
        for name, view in sources.items()
        if name in TABLES
    )


def _histogram(values: str, bins: int) -> str:
    """Bins of whole-number values given as SELECT x, n."""
    return f"""
        WITH v AS ({values}), b AS (
          SELECT MIN(x) AS a, MAX(x) AS z,
            CASE WHEN MIN(x) = MAX(x) THEN MIN(x) - 0.5 ELSE MIN(x) END AS low,
            CASE WHEN MIN(x) = MAX(x) THEN 1.0 ELSE MAX(x) - MIN(x) END AS span FROM v),
        g AS (SELECT unnest(range(0, {bins})) AS bin),
        p AS (SELECT least(CASE WHEN a = z THEN {bins} // 2
                                ELSE ((x - a) * {bins}) // nullif(z - a, 0) END, {bins - 1}) AS bin,
                SUM(n) AS n FROM v, b WHERE x IS NOT NULL GROUP BY 1)
        SELECT {whole("g.bin")} AS bin, {num(f"low + g.bin * CAST(span AS DOUBLE) / {bins}")} AS lo,
          {num(f"low + (g.bin + 1) * CAST(span AS DOUBLE) / {bins}")} AS hi,
          {whole("coalesce(p.n, 0)")} AS n
        FROM g CROSS JOIN b LEFT JOIN p ON g.bin = p.bin"""


def _with_parts_nested(sql: str) -> str:
    """Puts the parts in front of a query that already starts with its own WITH."""
    full = with_parts(sql.strip())
    if full.startswith("WITH ") and "\nWITH " in full:
        head, own = full.split("\nWITH ", 1)
        return f"{head},\n{own}"
    return full


def _scores(count: str = "orders") -> str:
    return (
        f"COUNT(*) AS {count}, {num('AVG(avg_score)', 2)} AS avg_score, "
        f"{num(pct('SUM(CASE WHEN avg_score <= 2 THEN 1 ELSE 0 END)', 'COUNT(*)'), 1)} "
        "AS bad_rate_pct"
    )


def _segment(name: str, where: str) -> str:
    return f"""SELECT '{name}' AS segment, COUNT(*) AS n, {num("AVG(avg_score)", 2)} AS avg_score,
        {num(pct("SUM(is_bad)", "COUNT(*)"), 1)} AS bad_rate,
        {num("AVG(is_delayed) * 100", 1)} AS delay_rate,
        {num("AVG(freight_ratio)", 1)} AS avg_freight_ratio FROM order_segments WHERE {where}"""


PARTS["order_segments"] = f"""
    SELECT o.order_id, MAX(CASE WHEN {_TRUNC} > 0 THEN 1 ELSE 0 END) AS is_delayed,
      {num("AVG(r.review_score)", 2)} AS avg_score,
      CASE WHEN AVG(r.review_score) <= 2 THEN 1 ELSE 0 END AS is_bad,
      {pct("SUM(i.freight_value)", "SUM(i.price)")} AS freight_ratio
    FROM a_items i JOIN a_orders o ON i.order_id = o.order_id
    JOIN a_reviews r ON i.order_id = r.order_id
    WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL
    GROUP BY o.order_id"""

_SEGMENT_TESTS = dict(
    zip(fv.SEGMENT_LABELS, ("true", "is_delayed = 1", "is_delayed = 0", "freight_ratio > 20"))
)


def _chi2(factors: Mapping[str, str]) -> str:
    """Over the full grid of levels, the textbook way."""
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS factor, CAST({col} AS VARCHAR) AS a, is_bad AS b FROM order_facts "
        f"WHERE {col} IS NOT NULL"
        for name, col in factors.items()
    )
    return f"""
        WITH x AS ({rows}),
        la AS (SELECT factor, a, COUNT(*) AS r FROM x GROUP BY ALL),
        lb AS (SELECT factor, b, COUNT(*) AS c FROM x GROUP BY ALL),
        cells AS (SELECT factor, a, b, COUNT(*) AS o FROM x GROUP BY ALL),
        tot AS (SELECT factor, COUNT(*) AS t, COUNT(DISTINCT a) AS na, COUNT(DISTINCT b) AS nb
                FROM x GROUP BY factor),
        grid AS (SELECT la.factor, t, na, nb, CAST(r AS DOUBLE) * c / t AS e,
                   coalesce(o, 0) AS o
                 FROM la JOIN lb ON la.factor = lb.factor JOIN tot ON tot.factor = la.factor
                 LEFT JOIN cells ON cells.factor = la.factor AND cells.a = la.a
                   AND cells.b = lb.b),
        chi AS (SELECT factor, any_value(t) AS t, any_value(na) AS na, any_value(nb) AS nb,
                  SUM(CASE WHEN (na - 1) * (nb - 1) = 1
                      THEN power(greatest(abs(o - e) - 0.5, 0), 2) / e
                      ELSE power(o - e, 2) / e END) AS chi2
                FROM grid GROUP BY factor)
        SELECT factor, {whole("t")} AS n, {num("chi2")} AS chi2,
          {whole("(na - 1) * (nb - 1)")} AS dof,
          {num("sqrt(chi2 / (t * (least(na, nb) - 1)))")} AS cramers_v FROM chi"""


_FEATURE_SQL = {
    "delay_days": "delay_days",
    "is_delayed": "is_delayed",
    "total_price": "total_price",
    "freight_ratio": "freight_ratio",
    "item_count": "item_count",
    "installments": "installments",
    "pay_type_credit": "CASE WHEN pay_type = 'credit_card' THEN 1 ELSE 0 END",
}

PARTS["features"] = (
    "SELECT order_id, "
    + ", ".join(f"CAST(coalesce({_FEATURE_SQL[f]}, 0) AS DOUBLE) AS {f}" for f in FEATURES)
    + ", is_bad FROM order_facts"
)


def _top_words(themes: Mapping[str, str]) -> str:
    lexicon = ", ".join(f"({quoted([w])}, {quoted([t])})" for w, t in themes.items())
    return f"""
        SELECT label, {whole("rn")} AS rank, ranked.word AS word, n,
          coalesce(theme, ranked.word) AS theme
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY n DESC, word) AS rn
              FROM (SELECT CASE WHEN review_score <= 2 THEN {quoted(fv.WORD_GROUP_LABELS[:1])}
                                WHEN review_score >= 4 THEN {quoted(fv.WORD_GROUP_LABELS[1:])}
                           END AS label, word, COUNT(*) AS n
                    FROM text_words GROUP BY ALL) WHERE label IS NOT NULL) ranked
        LEFT JOIN (VALUES {lexicon}) AS lexicon(word, theme) ON ranked.word = lexicon.word
        WHERE rn <= 20"""


def _theme_share(themes: Mapping[str, Sequence[str]]) -> str:
    late, on_time = (quoted([x]) for x in fv.SOURCE_GROUP_LABELS)
    return f"""
        WITH w AS (SELECT CASE WHEN delay_days > 0 THEN {late} ELSE {on_time} END AS label, word
                   FROM text_words WHERE review_score <= 2 AND delay_days IS NOT NULL),
        totals AS (SELECT label, COUNT(*) AS total FROM w GROUP BY label),
        hits AS (SELECT label, theme, COUNT(*) AS n FROM w JOIN {pairs(themes)}
                 ON w.word = lexicon.word GROUP BY ALL)
        SELECT l.label AS label, t.theme AS theme, {whole("coalesce(n, 0)")} AS n,
          {whole("coalesce(total, 0)")} AS total,
          {num(f"coalesce({pct('coalesce(n, 0)', 'total')}, 0)")} AS pct
        FROM (SELECT * FROM {listed(fv.SOURCE_GROUP_LABELS, "label")}) l
        CROSS JOIN (SELECT theme FROM {listed(list(themes), "theme")}) t
        LEFT JOIN totals ON totals.label = l.label
        LEFT JOIN hits ON hits.label = l.label AND hits.theme = t.theme"""


def _sample(where: str) -> str:
    return f"""
        SELECT review_id, {whole("review_score")} AS review_score, {_PHRASE} AS delay_text,
          substring(review_comment_message, 1, 200) AS shown FROM texts
        WHERE review_score <= 2 AND {where} AND length(review_comment_message) > 50
        ORDER BY md5(concat_ws('|', review_id, order_id, md5(review_comment_message), '42')),
          review_id, order_id LIMIT 5"""


_PHRASE = (
    "CASE WHEN delay_days < 0 THEN '提前' || abs(delay_days) || '天' "
    "WHEN delay_days = 0 THEN '0天(准时)' ELSE '+' || delay_days || '天' END"
)


def _sources(words: Sequence[str]) -> str:
    named = f"list_has_any(string_split(trim(cleaned), ' '), [{quoted(words)}])"
    late, on_time = "COUNT(*) FILTER (delay_days > 0)", "COUNT(*) FILTER (delay_days <= 0)"
    said = f"COUNT(*) FILTER ({named})"
    return f"""
        SELECT COUNT(*) AS n_bad, {late} AS n_late, {on_time} AS n_on_time, {said} AS n_named,
          {num(pct(late, "COUNT(*)"))} AS late_pct, {num(pct(on_time, "COUNT(*)"))} AS on_time_pct,
          {num(pct(said, "COUNT(*)"))} AS named_pct FROM texts WHERE review_score <= 2"""


PARTS["l0_words"] = """
    WITH u AS (SELECT review_id, unnest(terms) AS term FROM corpus_terms)
    SELECT term, COUNT(*) AS tf, COUNT(DISTINCT review_id) AS df FROM u GROUP BY term
    HAVING COUNT(DISTINCT review_id) >= 10
      AND COUNT(DISTINCT review_id) <= 0.5 * (SELECT COUNT(*) FROM corpus)
    ORDER BY tf DESC, term LIMIT 2000"""
PARTS["score_topics"] = f"""
    SELECT topic, word, rank FROM (
      SELECT topic, word, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY n DESC, word) AS rank
      FROM (SELECT CASE WHEN review_score <= 2 THEN 1 WHEN review_score >= 4 THEN 2 END AS topic,
              word, COUNT(*) AS n
            FROM (SELECT review_score, unnest(string_split(trim({_CLEAN}), ' ')) AS word
                  FROM a_text_reviews)
            WHERE length(word) > 2 AND word NOT IN ({quoted(fv.TOPIC_STOPWORDS)})
              AND review_score <> 3 GROUP BY ALL))
    WHERE rank <= 8"""


def _topic_label(
    lexicons: Mapping[str, Sequence[str]], words: str = "score_topics"
) -> str:
    return f"""
        WITH s AS (
          SELECT t.topic, l.ord, l.theme AS label, COUNT(h.word) AS score
          FROM (SELECT DISTINCT topic FROM {words} AS w) t
          CROSS JOIN (SELECT ord, theme FROM {listed(list(lexicons), "theme")}) l
          LEFT JOIN (SELECT topic, lexicon.theme, w.word FROM {words} AS w
                     JOIN {pairs(lexicons)} ON w.word = lexicon.word) h
            ON h.topic = t.topic AND h.theme = l.theme
          GROUP BY ALL)
        SELECT {whole("topic")} AS topic, {whole("place")} AS place, label,
          {whole("score")} AS score
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY score DESC, ord) AS place
              FROM s) WHERE place <= 2"""


def _digamma(x: str) -> str:
    y = f"({x} + {DIGAMMA_SHIFT})"
    series = f"ln{y} - 1 / (2 * {y}) - 1 / (12 * {y}**2) + 1 / (120 * {y}**4) - 1 / (252 * {y}**6)"
    return "(" + series + "".join(f" - 1 / ({x} + {i})" for i in range(DIGAMMA_SHIFT)) + ")"


_K = TOPIC_GROUPS
PARTS["grouped_matrix"] = f"""
    SELECT topic, v.term AS word, CAST(1 AS DOUBLE) / {_K} + COUNT(u.term) AS weight
    FROM (SELECT unnest(range(1, {_K} + 1)) AS topic)
    CROSS JOIN (SELECT term FROM l0_words) v
    LEFT JOIN (SELECT review_id, unnest(terms) AS term FROM corpus_terms) u
      ON u.term = v.term AND u.review_id % {_K} + 1 = topic
    GROUP BY topic, v.term"""
PARTS["grouped_topics"] = """
    SELECT * FROM (SELECT *, weight / SUM(weight) OVER (PARTITION BY topic) AS prob,
        ROW_NUMBER() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS rank
      FROM grouped_matrix) WHERE rank <= 12"""
# The words' weights in each topic, and then each document's parameters by as many steps.
PARTS["grouped_assigned"] = f"""
    WITH b AS (SELECT word, list(exp({_digamma("weight")} - {_digamma("total")}) ORDER BY topic) AS b
               FROM (SELECT *, SUM(weight) OVER (PARTITION BY topic) AS total FROM grouped_matrix)
               GROUP BY word),
    d AS (SELECT review_id, list({{'n': n, 'b': b}}) AS ws, SUM(n) AS n
          FROM (SELECT review_id, term, CAST(COUNT(*) AS DOUBLE) AS n
                FROM (SELECT review_id, unnest(terms) AS term FROM corpus_terms) GROUP BY ALL)
          JOIN b ON b.word = term GROUP BY review_id),
    g AS (SELECT review_id, list_reduce(
            [[1 / CAST({_K} AS DOUBLE) + n / {_K} FOR i IN range({_K})]]
              || [[CAST(0 AS DOUBLE)] FOR i IN range({FOLD_IN_STEPS})],
            lambda g, z: list_transform([[exp({_digamma("x")}) FOR x IN g]], lambda e:
              [1 / CAST({_K} AS DOUBLE) + e[t] * list_sum([w.n * w.b[t] / list_inner_product(e, w.b)
               FOR w IN ws]) FOR t IN range(1, {_K} + 1)])[1]) AS g FROM d)
    SELECT c.review_id, is_delayed, coalesce(list_position(
        [x >= list_max(g) * (1 - 1e-9) FOR x IN g], true), 1) AS topic
    FROM corpus c LEFT JOIN g ON g.review_id = c.review_id"""


def _grouped_labels(n_words: int) -> str:
    named = _topic_label(fv.TOPIC_LABEL_WORDS, f"(SELECT * FROM grouped_topics WHERE rank <= {n_words})")
    return f"(SELECT topic AS of_topic, place, label FROM ({named}))"


def _rates(where: str, k: str) -> str:
    return f"""
        SELECT category, orders, dr AS delay_rate, br AS bad_rate, {num("avg_gmv")} AS avg_gmv,
          {num("abs(dr - od)")} AS delay_gap_pp,
          CASE WHEN dr > od THEN '↑' ELSE '↓' END AS delay_flag,
          {num("abs(br - ob)")} AS bad_gap_pp,
          CASE WHEN br > ob THEN '↑' ELSE '↓' END AS bad_flag
        FROM (SELECT *, {even("delay_rate")} AS dr, {even("bad_rate")} AS br FROM category_stats)
        CROSS JOIN (SELECT AVG(is_delayed) * 100 AS od, AVG(is_bad) * 100 AS ob
                    FROM category_facts)
        WHERE {where} ORDER BY dr DESC, category {k}"""


def _lift(least: int) -> str:
    where = f"orders >= {least} AND delay_rate > 3 AND delayed_orders >= 10"
    return f"""
        WITH base AS (
          SELECT AVG(is_bad) FILTER (is_delayed = 0) * 100 AS bo,
            AVG(is_bad) FILTER (is_delayed = 1) * 100 AS bd FROM category_facts),
        listed AS (SELECT * FROM category_stats WHERE {where})
        SELECT category, orders, {num("delay_rate")} AS delay_rate,
          {num("bad_ontime")} AS bad_ontime, {num("bad_delayed")} AS bad_delayed,
          {num("bad_delayed - bad_ontime")} AS delta_pp,
          {num("bad_delayed / NULLIF(bad_ontime, 0)")} AS lift,
          CASE WHEN category IS NOT NULL THEN coalesce(bad_ontime <= 0, true) END
            AS lift_is_infinite,
          {num("bo")} AS base_ontime, {num("bd")} AS base_delayed
        FROM base LEFT JOIN listed ON true
        ORDER BY bad_delayed - bad_ontime DESC NULLS LAST, category LIMIT 15"""


PARTS["risk_rows"] = """
    SELECT *, CASE WHEN delayed_orders >= 10 THEN bad_delayed - bad_ontime ELSE 0 END AS delta,
      delay_rate * (bad_delayed - bad_ontime) / 100 AS score FROM category_stats"""


def _risk(least: int) -> str:
    return f"""
        SELECT category, orders, {num("delay_rate")} AS delay_rate,
          {num("bad_ontime")} AS bad_ontime, {num("bad_delayed")} AS bad_delayed,
          {num("delta")} AS delta_pp, {num("score")} AS risk_score
        FROM risk_rows WHERE orders >= {least}
        ORDER BY score DESC NULLS LAST, category LIMIT 12"""


def _volume(least: int) -> str:
    return f"""
        SELECT category, orders, {whole("delayed_orders")} AS delayed_orders,
          {whole("bad_orders")} AS bad_orders, delayed_bad, ontime_bad,
          CAST(total_gmv AS DOUBLE) AS total_gmv,
          {num(f"coalesce({pct('delayed_bad', 'bad_orders')}, 0)")} AS bad_from_delayed_pct
        FROM category_stats WHERE orders >= {least}
        ORDER BY delayed_bad DESC, category LIMIT 12"""


def _tiers(least: int) -> str:
    return f"""
        WITH pool AS (SELECT * FROM risk_rows WHERE orders >= {least}),
        top AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC NULLS LAST, category) AS place
                FROM pool QUALIFY place <= 12),
        m AS (SELECT (SELECT median(score) FROM top) AS ms,
                (SELECT median(bad_orders) FROM pool) AS mb),
        tiered AS (SELECT *, CASE WHEN score > ms AND bad_orders > mb THEN 'A'
                                  WHEN score > ms AND bad_orders <= mb THEN 'B'
                                  WHEN score <= ms AND bad_orders > mb THEN 'C' END AS tier
                   FROM top, m)
        SELECT tier, {whole("tp")} AS tier_place, category, {num("delay_rate")} AS delay_rate,
          {num("delta")} AS delta_pp, {num("score")} AS risk_score,
          {whole("bad_orders")} AS share_of_bad
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tier ORDER BY place) AS tp FROM tiered
              WHERE tier IS NOT NULL)
        WHERE tier = 'A' OR tp <= 5"""


_LEVELS = (
    f"CASE WHEN delay_days <= 0 THEN {quoted(fv.DELAY_LEVEL_LABELS[:1])} "
    f"WHEN delay_days <= 10 THEN {quoted(fv.DELAY_LEVEL_LABELS[1:2])} "
    f"WHEN delay_days > 10 THEN {quoted(fv.DELAY_LEVEL_LABELS[2:])} END"
)

_BY_DELAY = case("delay_days", fv.DELAY_LADDER)

def _odds_ratios() -> str:
    """Newton steps over the standardized rows; each solves its equations by elimination on a
    list of rows, the last entry of each being the right side."""
    names = list(FEATURES)
    size = len(names) + 1
    scaled = ", ".join(
        f"({f} - AVG({f}) OVER ()) / coalesce(NULLIF(stddev_pop({f}) OVER (), 0), 1) AS x{i + 1}"
        for i, f in enumerate(names)
    )
    z = " + ".join(f"w[{i + 1}] * x{i}" for i in range(size))
    rows = ", ".join(
        "[" + ", ".join(
            f"SUM(q * x{i} * x{j})" + (" + 1" if i == j and i else "") for j in range(size)
        ) + f", SUM((p - y) * x{i})" + (f" + w[{i + 1}]" if i else "") + "]"
        for i in range(size)
    )
    solved = f"""list_reduce([m] || [[[CAST(k AS DOUBLE)]] FOR k IN range(1, {size + 1})],
        lambda a, k: [CASE WHEN i = k[1][1]
            THEN [a[i][j] / a[i][i] FOR j IN range(1, {size + 2})]
            ELSE [a[i][j] - a[i][CAST(k[1][1] AS INT)] * a[CAST(k[1][1] AS INT)][j]
                  / a[CAST(k[1][1] AS INT)][CAST(k[1][1] AS INT)] FOR j IN range(1, {size + 2})] END
          FOR i IN range(1, {size + 1})])"""
    stds = ", ".join(f"coalesce(NULLIF(stddev_pop({f}), 0), 1)" for f in names)
    phrases = ", ".join(quoted([FEATURES[f] + PHRASE]) for f in names)
    return f"""
        SELECT * FROM (WITH RECURSIVE r AS (SELECT CAST(1 AS DOUBLE) AS x0, {scaled},
            CAST(is_bad AS DOUBLE) AS y FROM features),
        fit AS (
          SELECT 0 AS i, [CAST(0 AS DOUBLE) FOR k IN range({size})] AS w
          UNION ALL
          SELECT i + 1, [w[k] - s[k][{size + 1}] FOR k IN range(1, {size + 1})]
          FROM (SELECT i, w, {solved} AS s
                FROM (SELECT i, w, [{rows}] AS m
                      FROM (SELECT *, p * (1 - p) AS q
                            FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM fit, r WHERE i < 10))
                      GROUP BY i, w))),
        spread AS (SELECT [{stds}] AS stds FROM features),
        told AS (SELECT [{quoted(names)}][k] AS feature, w[k + 1] AS coef, stds[k] AS std,
                   [{phrases}][k] AS phrase
                 FROM fit, spread, unnest(range(1, {size})) AS u(k) WHERE i = 10)
        SELECT feature, {num("coef", 3)} AS coef, {num("exp(coef)", 3)} AS or_per_std,
          {num("exp(coef / std)", 3)} AS or_per_unit,
          phrase || printf('%.2f', exp(coef)) AS interpretation FROM told)"""


RAW: dict[str, str] = {
    "read_tables": _profile({"reviews": "a_text_reviews"}),
    "parse_timestamps": f"SELECT order_id, {', '.join(map(_time, TIMESTAMP_COLUMNS))} "
    "FROM a_orders",
    "table_sink": _profile(),
    "profile_tables": _profile(),
    "time_span": """SELECT strftime(MIN(order_purchase_timestamp), '%Y-%m-%d %H:%M:%S') AS min_ts,
        strftime(MAX(order_purchase_timestamp), '%Y-%m-%d %H:%M:%S') AS max_ts FROM a_orders""",
    "filter_delivered": """
        SELECT order_id, 'both' AS kind FROM a_orders WHERE order_status = 'delivered'
          AND order_delivered_customer_date IS NOT NULL
          AND order_estimated_delivery_date IS NOT NULL
        UNION ALL SELECT order_id, 'arrival' FROM a_orders WHERE order_status = 'delivered'
          AND order_delivered_customer_date IS NOT NULL
        UNION ALL SELECT order_id, 'status' FROM a_orders WHERE order_status = 'delivered'""",
    "delay_days_eda": """SELECT order_id, actual_delivery_days, estimated_delivery_days,
        delay_days FROM delivered_eda""",
    "delay_days_sql": "SELECT order_id, delay_days FROM delivered_sql",
    "delay_flags": """SELECT order_id, CASE WHEN delay_days > 0 THEN 1 ELSE 0 END AS is_delayed,
        CASE WHEN delay_days > 4 THEN 1 ELSE 0 END AS is_severely_delayed FROM delivered_sql""",
    "delay_bucket_7": f"""SELECT order_id, {_BY_DELAY} AS bucket,
        {case("delay_days", fv.DELAY_LADDER, rank=True)} AS bucket_ord FROM delivered_sql""",
    "delay_group_6": f"""SELECT order_id,
        {cut_case("delay_days", fv.DELAY_CUT_EDGES, fv.DELAY_CUT_LABELS)} AS delay_group
        FROM delivered_sql""",
    "delay_level_3": f"SELECT order_id, {_LEVELS} AS level FROM delivered_eda",
    "sentiment_cut": f"""SELECT order_id, review_score,
        {cut_case("review_score", fv.SCORE_CUT_EDGES, fv.SCORE_CUT_LABELS)} AS label,
        COUNT(*) AS n FROM a_reviews GROUP BY ALL""",
    "freight_ratio": f"""SELECT order_id, {num("freight_ratio")} AS freight_ratio
        FROM order_freight""",
    "freight_bucket": f"""SELECT order_id, {case("freight_ratio", fv.FREIGHT_LADDER)} AS bucket,
        {case("freight_ratio", fv.FREIGHT_LADDER, rank=True)} AS bucket_ord FROM order_freight""",
    "installment_bucket": f"""SELECT payment_installments,
        {case("payment_installments", fv.INSTALLMENT_LADDER)} AS bucket, COUNT(*) AS n
        FROM a_payments GROUP BY ALL""",
    "purchase_month": """SELECT order_id, strftime(order_purchase_timestamp, '%Y-%m') AS month
        FROM a_orders""",
    "category_fallback": """
        SELECT p.product_id, coalesce(product_category_name_english, p.product_category_name)
            AS category_eda, coalesce(product_category_name_english, 'Unknown') AS category_sql
        FROM a_products p LEFT JOIN a_category_trans c
          ON p.product_category_name = c.product_category_name""",
    "clip_values": f"""
        SELECT order_id, CASE WHEN d IS NOT NULL THEN least(greatest(d, -30), 50) END AS both,
          CASE WHEN d IS NOT NULL THEN least(d, 10) END AS upper
        FROM (SELECT order_id,
            {_floor("order_delivered_customer_date", "order_purchase_timestamp")}
            - {_floor("order_estimated_delivery_date", "order_purchase_timestamp")} AS d
          FROM a_orders)""",
    "delay_to_text": f"SELECT order_id, {_PHRASE} AS phrase FROM delivered_sql",
    "text_prefix": """SELECT review_id, substring(review_comment_message, 1, 200) AS prefix
        FROM a_text_reviews""",
    "pp_vs_overall": f"""SELECT category, delay_gap_pp, delay_flag, bad_gap_pp, bad_flag
        FROM ({_rates("orders >= 1", "")})""",
    "join_orders_reviews": f"""SELECT o.order_id, order_status, {num("avg_score")} AS avg_score,
        n_reviews FROM a_orders o JOIN order_reviews r ON o.order_id = r.order_id""",
    "join_items_products": """SELECT original AS product_category_name, COUNT(*) AS n,
        CAST(SUM(price) AS DOUBLE) AS price FROM item_category GROUP BY original""",
    "left_join_products": """SELECT p.product_category_name, COUNT(*) AS n,
        CAST(SUM(freight_value) AS DOUBLE) AS freight
        FROM a_items i LEFT JOIN a_products p ON i.product_id = p.product_id GROUP BY 1""",
    "left_join_category": """SELECT p.product_id, p.product_category_name,
        c.product_category_name_english FROM a_products p LEFT JOIN a_category_trans c
        ON p.product_category_name = c.product_category_name""",
    "left_join_top_payment": """SELECT o.order_id, payment_type AS pay_type,
        payment_installments AS installments
        FROM a_orders o LEFT JOIN top_pay p ON o.order_id = p.order_id""",
    "map_lookup": f"""SELECT c.product_category_name_english AS category,
        coalesce({num(even("delay_rate"))}, 0) AS delay_rate_or_0 FROM a_category_trans c
        LEFT JOIN (SELECT * FROM category_stats WHERE orders >= 100) s
          ON s.category = c.product_category_name_english""",
    "row_number_top1": """SELECT order_id, payment_type, payment_installments,
        CAST(payment_value AS DOUBLE) AS payment_value FROM top_pay""",
    "running_share": f"SELECT seller_id, {num('cum_pct')} AS cum_pct FROM lorenz",
    "rank_percentile": f"""SELECT seller_id, rank, {num(pct("rank", "n_total"))} AS rank_pct
        FROM lorenz""",
    "sort_topk": """SELECT order_id, CAST(total_price AS DOUBLE) AS total_price FROM order_freight
        ORDER BY order_freight.total_price DESC, order_id LIMIT 10""",
    "nlargest": f"""SELECT order_id, {num("freight_ratio")} AS freight_ratio FROM order_freight
        WHERE freight_ratio IS NOT NULL
        ORDER BY order_freight.freight_ratio DESC, order_id LIMIT 15""",
    "order_by_bucket_min": f"""SELECT {_BY_DELAY} AS delay_bucket, COUNT(*) AS n,
        MIN(delay_days) AS first_delay FROM delivered_sql GROUP BY 1""",
    "manual_sort": f"""SELECT delay_bucket, ords, {whole("l.ord + 1")} AS ord FROM dose
        JOIN (SELECT * FROM {listed(fv.DOSE_ORDER, "name")}) l ON l.name = dose.delay_bucket""",
    "union_segments": " UNION ALL ".join(
        f"SELECT order_id, '{name}' AS segment FROM order_segments WHERE {test}"
        for name, test in _SEGMENT_TESTS.items()
    ),
    "eda_monthly_orders": """SELECT strftime(order_purchase_timestamp, '%Y-%m') AS month,
        COUNT(*) AS n FROM a_orders GROUP BY 1""",
    "eda_status_dist": f"""SELECT order_status, COUNT(*) AS n,
        {num("COUNT(*) * 100.0 / (SELECT COUNT(*) FROM a_orders)")} AS pct
        FROM a_orders GROUP BY order_status""",
    "eda_delivery_stats": f"""SELECT {num("AVG(actual_delivery_days)")} AS mean_actual,
        {num("AVG(estimated_delivery_days)")} AS mean_estimated,
        CAST(median(delay_days) AS DOUBLE) AS median_delay FROM delivered_eda""",
    "eda_delay_rates": f"""
        SELECT {num(pct("COUNT(*) FILTER (delay_days > 0)", "COUNT(*)"))} AS delayed_pct,
          {num(pct("COUNT(*) FILTER (delay_days <= 0)", "COUNT(*)"))} AS on_time_pct,
          {num(pct("COUNT(*) FILTER (delay_days > 10)", "COUNT(*)"))} AS severe_pct
        FROM delivered_eda""",
    "eda_delay_hist": _histogram(
        "SELECT least(greatest(delay_days, -30), 50) AS x, COUNT(*) AS n FROM delivered_eda "
        "WHERE delay_days IS NOT NULL GROUP BY 1",
        fv.DELAY_BINS,
    ),
    "eda_delay_box": f"""
        WITH d AS (SELECT {_LEVELS} AS level, delay_days FROM delivered_eda
                   WHERE delay_days IS NOT NULL),
        q AS (SELECT level, quantile_cont(delay_days, 0.25) AS q1,
                quantile_cont(delay_days, 0.5) AS q2, quantile_cont(delay_days, 0.75) AS q3
              FROM d GROUP BY level)
        SELECT d.level AS level, COUNT(*) AS n, {num("any_value(q1)")} AS q1,
          {num("any_value(q2)")} AS median, {num("any_value(q3)")} AS q3,
          {num('''least(MIN(delay_days) FILTER (delay_days >= q1 - 1.5 * (q3 - q1)),
                        any_value(q1))''')} AS whisker_low,
          {num('''greatest(MAX(delay_days) FILTER (delay_days <= q3 + 1.5 * (q3 - q1)),
                           any_value(q3))''')} AS whisker_high
        FROM d JOIN q ON d.level = q.level GROUP BY d.level""",
    "eda_score_dist": f"""SELECT review_score, COUNT(*) AS n,
        {num("COUNT(*) * 100.0 / (SELECT COUNT(*) FROM a_reviews)")} AS pct
        FROM a_reviews GROUP BY review_score""",
    "eda_sentiment": f"""
        SELECT {cut_case("review_score", fv.SCORE_CUT_EDGES, fv.SCORE_CUT_LABELS)} AS label,
          COUNT(*) AS n, {num("COUNT(*) * 100.0 / (SELECT COUNT(*) FROM a_reviews)")} AS pct
        FROM a_reviews GROUP BY 1""",
    "eda_seller_stats": f"""SELECT seller_id, COUNT(*) AS n_items,
        CAST(SUM(price) AS DOUBLE) AS gmv,
        {num("CAST(SUM(price) AS DOUBLE) / COUNT(price)")} AS mean_price
        FROM a_items GROUP BY seller_id""",
    "eda_seller_lorenz": f"""SELECT seller_id, CAST(gmv AS DOUBLE) AS gmv, rank,
        {num("cum_pct")} AS cum_pct, {num(pct("rank", "n_total"))} AS rank_pct FROM lorenz""",
    "eda_pareto": " UNION ALL ".join(
        f"""SELECT {whole(str(p))} AS top_pct, COUNT(*) FILTER (rank <= n_total * {p} // 100)
            AS n_sellers, {num(pct(f"coalesce(SUM(gmv) FILTER (rank <= n_total * {p} // 100), 0)",
                                   "SUM(gmv)"))} AS gmv_pct FROM lorenz"""
        for p in (1, 5, 10)
    ),
    "eda_seller_order_hist": _histogram(
        "SELECT least(n_items, 500) AS x, COUNT(*) AS n FROM seller_gmv GROUP BY 1",
        fv.SELLER_ORDER_BINS,
    ),
    "eda_installment_hist": _histogram(
        "SELECT payment_installments AS x, COUNT(*) AS n FROM a_payments "
        "WHERE payment_installments <= 12 GROUP BY 1",
        fv.INSTALLMENT_BINS,
    ),
    "eda_payment_types": f"""SELECT payment_type, COUNT(*) AS n,
        {even("AVG(payment_installments)")} AS mean_installments,
        {num("COUNT(*) * 100.0 / (SELECT COUNT(*) FROM a_payments)")} AS pct
        FROM a_payments GROUP BY payment_type""",
    "eda_summary": f"""
        SELECT d.*, s.*, g.* FROM
        (SELECT {num(pct("COUNT(*) FILTER (delay_days > 0)", "COUNT(*)"))} AS delayed_pct,
           {num(pct("COUNT(*) FILTER (delay_days > 10)", "COUNT(*)"))} AS severe_pct
         FROM delivered_eda) d,
        (SELECT {num(pct("COUNT(*) FILTER (review_score >= 4)", "COUNT(*)"))} AS good_pct,
           {num(pct("COUNT(*) FILTER (review_score <= 2)", "COUNT(*)"))} AS bad_pct
         FROM a_reviews) s,
        (SELECT {num(pct("coalesce(SUM(gmv) FILTER (rank <= n_total * 10 // 100), 0)",
                         "SUM(gmv)"))} AS top10_gmv_pct FROM lorenz) g""",
    "order_review_avg": f"""SELECT order_id, {num("avg_score")} AS avg_score, n_reviews
        FROM order_reviews""",
    "order_freight_agg": f"""SELECT order_id, CAST(total_freight AS DOUBLE) AS total_freight,
        CAST(total_price AS DOUBLE) AS total_price, {num("freight_ratio")} AS freight_ratio
        FROM order_freight""",
    "order_pay_agg": "SELECT * FROM order_pay",
    "q1_delay_dose": f"""
        SELECT {_BY_DELAY} AS delay_bucket, COUNT(*) AS order_cnt,
          {num("AVG(avg_score)", 2)} AS avg_review_score,
          {num(pct("SUM(CASE WHEN avg_score <= 2 THEN 1 ELSE 0 END)", "COUNT(*)"), 1)}
            AS bad_rate_pct
        FROM delivered_sql d JOIN order_reviews r ON d.order_id = r.order_id GROUP BY 1""",
    "q2_freight_ratio": f"""
        SELECT {case("freight_ratio", fv.FREIGHT_LADDER)} AS freight_ratio_bucket, {_scores()},
          {num("CAST(SUM(total_price) AS DOUBLE) / COUNT(*)", 0)} AS avg_order_value
        FROM order_freight f JOIN order_reviews r ON f.order_id = r.order_id GROUP BY 1""",
    "q3_category_bad_rate": f"""
        SELECT coalesce(english, 'Unknown') AS category, COUNT(DISTINCT i.order_id) AS orders,
          COUNT(*) AS n_items, {num("AVG(avg_score)", 2)} AS avg_score,
          {num(pct("SUM(CASE WHEN avg_score <= 2 THEN 1 ELSE 0 END)", "COUNT(*)"), 1)}
            AS bad_rate_pct
        FROM item_category i JOIN order_reviews r ON i.order_id = r.order_id
        GROUP BY english HAVING COUNT(DISTINCT i.order_id) >= 100
        ORDER BY bad_rate_pct DESC, category LIMIT 15""",
    "q4_payment_installments": f"""
        SELECT pay_type, {case("installments", fv.INSTALLMENT_LADDER)} AS installment_bucket,
          {_scores()}
        FROM order_pay p JOIN order_reviews r ON p.order_id = r.order_id
        WHERE pay_type IN ('credit_card', 'boleto') GROUP BY 1, 2""",
    "q5_segments": " UNION ALL ".join(_segment(n, w) for n, w in _SEGMENT_TESTS.items()),
    "q6_review_group_delay": f"""
        SELECT CASE WHEN avg_score <= 2 THEN 'Bad(1-2分)' WHEN avg_score >= 4 THEN 'Good(4-5分)'
                    ELSE 'Neutral(3分)' END AS review_group, COUNT(*) AS orders,
          {num("AVG(delay_days)", 1)} AS avg_delay_days,
          {num("AVG(CASE WHEN delay_days > 0 THEN delay_days END)", 1)} AS avg_delay_when_late,
          {num(pct("SUM(CASE WHEN delay_days > 0 THEN 1 ELSE 0 END)", "COUNT(*)"), 1)}
            AS delay_rate_pct
        FROM (SELECT order_id, {_TRUNC} AS delay_days FROM a_orders
              WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL) d
        JOIN order_reviews r ON d.order_id = r.order_id GROUP BY 1""",
    "order_facts": f"""
        SELECT order_id, delay_days, is_delayed, is_severely_delayed, avg_score, is_bad,
          CAST(total_price AS DOUBLE) AS total_price,
          CAST(total_freight AS DOUBLE) AS total_freight,
          {num("freight_ratio")} AS freight_ratio, item_count, pay_type, installments,
          main_category FROM order_facts""",
    "order_facts_dedup": """
        SELECT o.order_id, CAST(SUM(price) AS DOUBLE) AS total_price,
          CAST(SUM(freight_value) AS DOUBLE) AS total_freight
        FROM delivered_sql o JOIN item_category i ON o.order_id = i.order_id
        WHERE o.order_id IN (SELECT order_id FROM a_reviews) GROUP BY o.order_id""",
    "order_facts_category": """
        SELECT order_id, is_delayed, is_bad, category, CAST(gmv AS DOUBLE) AS gmv,
          CAST(freight AS DOUBLE) AS freight, items FROM category_facts""",
    "facts_summary": f"""
        SELECT COUNT(*) AS n_orders, {num(pct("SUM(is_bad)", "COUNT(*)"))} AS bad_pct,
          {num(pct("SUM(is_delayed)", "COUNT(*)"))} AS delayed_pct,
          {num(pct("SUM(is_severely_delayed)", "COUNT(*)"))} AS severe_pct,
          COUNT(DISTINCT main_category) AS n_categories FROM order_facts""",
    "facts_summary_category": f"""
        SELECT COUNT(*) AS n_orders, {num(pct("SUM(is_bad)", "COUNT(*)"))} AS bad_pct,
          {num(pct("SUM(is_delayed)", "COUNT(*)"))} AS delayed_pct,
          CAST(NULL AS DOUBLE) AS severe_pct, COUNT(DISTINCT category) AS n_categories FROM category_facts""",
    "t1_contingency": " UNION ALL ".join(
        f"SELECT '{c}' AS factor, CAST({c} AS VARCHAR) AS level, {whole('is_bad')} AS outcome, "
        f"COUNT(*) AS n FROM order_facts GROUP BY ALL"
        for c in ("is_delayed", "is_severely_delayed")
    ),
    "t1_chi2": _chi2({c: c for c in ("is_delayed", "is_severely_delayed")}),
    "t1_chi2_wide": _chi2({c: c for c in ("main_category", "pay_type")}),
    "t1_p_value": f"""
        WITH t AS (SELECT *, dof / 2.0 AS a, CAST(chi2 AS DOUBLE) / 2 AS x FROM (
          {_chi2({c: c for c in ("is_delayed", "is_severely_delayed")})})),
        lower AS (SELECT factor, SUM(exp((a + k) * ln(x) - x - lgamma(a + k + 1))) AS p
                  FROM t, range(1000) AS r(k) WHERE x > 0 GROUP BY factor)
        SELECT t.factor, n, chi2, dof, cramers_v,
          {num("CASE WHEN x > 0 THEN 1 - p ELSE 1 END", 3)} AS p_value
        FROM t LEFT JOIN lower ON lower.factor = t.factor""",
    "t2_stratified": f"""
        SELECT CASE WHEN freight_ratio <= 15 THEN {quoted(fv.STRATUM_LABELS[:1])}
                    ELSE {quoted(fv.STRATUM_LABELS[1:])} END AS stratum, COUNT(*) AS n,
          {num("AVG(is_bad) FILTER (is_delayed = 1) * 100")} AS bad_delayed_pct,
          {num("AVG(is_bad) FILTER (is_delayed = 0) * 100")} AS bad_ontime_pct,
          {num('''abs(AVG(is_bad) FILTER (is_delayed = 1)
                      - AVG(is_bad) FILTER (is_delayed = 0)) * 100''')} AS gap_pp
        FROM order_facts WHERE freight_ratio IS NOT NULL GROUP BY 1""",
    "t3_features": "SELECT order_id, "
    + ", ".join(f"{num(f)} AS {f}" for f in FEATURES)
    + ", is_bad FROM features",
    "t3_standardize": "SELECT order_id, "
    + ", ".join(
        f"{num(f'({f} - AVG({f}) OVER ()) / coalesce(NULLIF(stddev_pop({f}) OVER (), 0), 1)')} "
        f"AS {f}"
        for f in FEATURES
    )
    + ", is_bad FROM features",
    "t3_odds_ratios": _odds_ratios(),
    "t4_relative_risk": f"""
        WITH g AS (SELECT {cut_case("delay_days", fv.DELAY_CUT_EDGES, fv.DELAY_CUT_LABELS)}
                     AS delay_group, COUNT(*) AS n, AVG(is_bad) * 100 AS rate
                   FROM order_facts GROUP BY 1),
        b AS (SELECT MAX(rate) FILTER (delay_group = {quoted([fv.DELAY_CUT_BASELINE])}) AS base
              FROM g)
        SELECT l.delay_group AS delay_group, {whole("coalesce(n, 0)")} AS n,
          {num("rate")} AS rate_pct, {num("rate / NULLIF(base, 0)")} AS rr,
          coalesce(base <= 0, true) AS rr_is_infinite, {num("base")} AS base_pct,
          CASE WHEN rate / NULLIF(base, 0) > 3 OR (base = 0 AND rate > 0) THEN 'high'
               WHEN rate / NULLIF(base, 0) <= 1.2 THEN 'low' ELSE '' END AS mark
        FROM (SELECT * FROM {listed(fv.DELAY_CUT_LABELS, "delay_group")}) l
        LEFT JOIN g ON g.delay_group = l.delay_group CROSS JOIN b""",
    "t5_model": f"""
        SELECT * FROM (WITH RECURSIVE d AS (SELECT CAST(delay_days AS DOUBLE) AS x, COUNT(*) AS n,
            SUM(is_bad) AS k FROM order_facts WHERE delay_days IS NOT NULL GROUP BY 1),
        fit AS (
          SELECT 0 AS i, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b
          UNION ALL
          SELECT i + 1, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb),
            b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb)
          FROM (SELECT i, w, b, SUM(n * p * (1 - p) * x * x) + 1 AS hww,
                  SUM(n * p * (1 - p) * x) AS hwb, SUM(n * p * (1 - p)) AS hbb,
                  SUM((n * p - k) * x) + w AS gw, SUM(n * p - k) AS gb
                FROM (SELECT i, w, b, x, n, k, 1 / (1 + exp(-w * x - b)) AS p FROM fit, d)
                GROUP BY i, w, b)
          WHERE i < 12)
        SELECT 'delay_days' AS feature, {num("w", 3)} AS coef, {num("b", 3)} AS intercept
        FROM fit WHERE i = 12)""",
    "t5_auc": f"""
        WITH x AS (SELECT CAST(delay_days AS DOUBLE) AS x, is_bad FROM order_facts),
        r AS (SELECT *, rank() OVER (ORDER BY x)
                + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM x),
        s AS (SELECT COUNT(*) AS n, SUM(is_bad) AS p, SUM(rk) FILTER (is_bad = 1) AS rp,
                covar_pop(x, is_bad) AS cov FROM r),
        a AS (SELECT *, (rp - p * (p + 1) / 2.0) / NULLIF(p * (n - p), 0) AS auc FROM s)
        SELECT n, {whole("p")} AS n_bad,
          {num("CASE WHEN cov > 0 THEN auc WHEN cov < 0 THEN 1 - auc ELSE 0.5 END")} AS auc
        FROM a""",
    "t6_threshold_scan": f"""
        SELECT {whole("t")} AS threshold, COUNT(*) FILTER (delay_days > t) AS n_above,
          {num("AVG(is_bad) FILTER (delay_days > t) * 100")} AS bad_above_pct,
          {num("AVG(is_bad) FILTER (delay_days <= t) * 100")} AS bad_upto_pct,
          {num('''AVG(is_bad) FILTER (delay_days > t)
                  / NULLIF(AVG(is_bad) FILTER (delay_days <= t), 0)''')} AS lift,
          coalesce(AVG(is_bad) FILTER (delay_days <= t) <= 0, true) AS lift_is_infinite
        FROM order_facts CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 7, 10]) AS t) GROUP BY t
        HAVING COUNT(*) FILTER (delay_days > t) > 100""",
    "n0_review_texts": """SELECT review_id, review_score, delay_days,
        length(review_comment_message) AS n_chars FROM texts""",
    "n0_group_counts": f"""
        SELECT COUNT(*) AS n, COUNT(*) FILTER (review_score <= 2) AS n_bad,
          COUNT(*) FILTER (review_score >= 4) AS n_good,
          COUNT(*) FILTER (review_score = 3) AS n_neutral,
          COUNT(*) FILTER (review_score <= 2 AND delay_days > 0) AS n_bad_late,
          COUNT(*) FILTER (review_score <= 2 AND delay_days <= 0) AS n_bad_on_time,
          {num(pct("COUNT(*) FILTER (review_score <= 2)", "COUNT(*)"))} AS bad_pct FROM texts""",
    "clean_text": f"SELECT review_id, {_CLEAN} AS cleaned FROM a_text_reviews",
    "tokenize": f"""
        SELECT review_id, len(t) AS n_tokens, coalesce(array_to_string(t, ' '), '') AS tokens
        FROM (SELECT review_id, list_filter(string_split(trim({_CLEAN}), ' '), lambda w:
                length(w) > 2 AND w NOT IN ({quoted(fv.STOPWORDS)})) AS t FROM a_text_reviews)""",
    "n1_top_words": _top_words(fv.WORD_THEMES),
    "n1_top_words_sample_themes": _top_words(SAMPLE_WORD_THEMES),
    "n2_theme_share": _theme_share(fv.THEME_WORDS),
    "n2_theme_share_sample_themes": _theme_share(SAMPLE_THEMES),
    "n3_sample_late": _sample("delay_days > 0"),
    "n4_sample_on_time": _sample("delay_days <= 0"),
    "n5_bad_sources": _sources(fv.DELAY_WORDS),
    "n5_bad_sources_sample_words": _sources(SAMPLE_WORDS),
    "l0_corpus": """SELECT review_id, delay_days, is_delayed, cleaned_text AS cleaned
        FROM corpus""",
    "l0_ngrams": """SELECT review_id, len(terms) AS n_terms, array_to_string(terms, '|') AS terms
        FROM corpus_terms""",
    "l0_vocabulary": "SELECT term, tf, df FROM l0_words",
    "l2_topic_label": _topic_label(fv.TOPIC_LABEL_WORDS),
    "l2_topic_label_sample_themes": _topic_label(SAMPLE_THEMES),
    "l1_grouped_topics": f"""SELECT {whole("topic")} AS topic, {whole("rank")} AS rank, word,
        {num("weight")} AS weight, {num("prob")} AS prob FROM grouped_topics""",
    "l2_grouped_topic_share": f"""
        WITH l AS (SELECT of_topic, MAX(label) FILTER (place = 1) AS label_1,
                     MAX(label) FILTER (place = 2) AS label_2 FROM {_grouped_labels(8)} GROUP BY 1),
        n AS (SELECT topic, COUNT(*) AS n FROM grouped_assigned GROUP BY topic)
        SELECT {whole("k")} AS topic, {whole("coalesce(n, 0)")} AS n,
          {num(f"coalesce({pct('coalesce(n, 0)', 'SUM(n) OVER ()')}, 0)")} AS pct, label_1, label_2
        FROM (SELECT unnest(range(1, {_K} + 1)) AS k) LEFT JOIN n ON n.topic = k
        LEFT JOIN l ON of_topic = k""",
    "l3_grouped_topic_by_delay": f"""
        WITH n AS (SELECT topic, COUNT(*) FILTER (is_delayed = 1) AS late,
                     COUNT(*) FILTER (is_delayed = 0) AS on_time FROM grouped_assigned GROUP BY topic),
        s AS (SELECT k, coalesce(late, 0) AS late, coalesce(on_time, 0) AS on_time,
                coalesce({pct('coalesce(late, 0)', 'SUM(late) OVER ()')}, 0) AS late_pct,
                coalesce({pct('coalesce(on_time, 0)', 'SUM(on_time) OVER ()')}, 0) AS on_time_pct
              FROM (SELECT unnest(range(1, {_K} + 1)) AS k) LEFT JOIN n ON n.topic = k)
        SELECT {whole("k")} AS topic, label, {whole("late")} AS n_late,
          {whole("on_time")} AS n_on_time, {num("late_pct")} AS late_pct,
          {num("on_time_pct")} AS on_time_pct,
          {num("late_pct / NULLIF(on_time_pct, 0)")} AS concentration,
          on_time_pct = 0 AS concentration_is_infinite,
          CASE WHEN on_time_pct = 0 OR late_pct / on_time_pct > 1.8 THEN 'late'
               WHEN late_pct / on_time_pct < 0.5 THEN 'on_time' ELSE '' END AS mark
        FROM s LEFT JOIN {_grouped_labels(6)} ON of_topic = k AND place = 1""",
    "r1_category_rates": _rates("orders >= 100", "LIMIT 10"),
    "r2_delay_lift": _lift(200),
    "r2_delay_lift_small": _lift(50),
    "r3_risk_score": _risk(200),
    "r3_risk_score_small": _risk(50),
    "r4_bad_volume": _volume(200),
    "r4_bad_volume_small": _volume(50),
    "r5_tiers": _tiers(200),
    "r5_tiers_small": _tiers(50),
    "rollup_kpi": "SELECT * FROM kpi",
    "rollup_monthly": "SELECT * FROM monthly",
    "rollup_delay_dose": "SELECT * FROM dose",
    "rollup_group_compare": "SELECT * FROM group_compare",
    "rollup_category_risk": "SELECT * FROM category_risk",
    "rollup_payment": f"""
        SELECT pay_type AS pt, COUNT(*) AS "to", {whole("SUM(bad)")} AS br,
          {num(pct("SUM(bad)", "COUNT(*)"), 1)} AS brr,
          {num(pct("SUM(late)", "COUNT(*)"), 1)} AS dr, {num("AVG(installments)", 1)} AS ai,
          {num("CAST(SUM(paid) AS DOUBLE) / COUNT(paid)", 2)} AS av
        FROM rollup_facts GROUP BY pay_type""",
    "unpivot_metrics": " UNION ALL ".join(
        f"SELECT rg, '{m}' AS metric, \"{m}\" AS value FROM group_compare"
        for m in fv.PIVOT_METRICS
    ),
    "kpi_member_filter": f"SELECT * FROM kpi WHERE metric = {quoted([fv.KPI_ROWS[1][0]])}",
    "dash_top10_bad": f"""
        SELECT product_category_name_english, {whole("SUM(br)")} AS sum_br,
          {num("SUM(brr)")} AS sum_brr FROM category_risk GROUP BY 1
        ORDER BY sum_br DESC, product_category_name_english LIMIT 10""",
    "dash_dose_sum": f"""SELECT delay_bucket, {num("brate")} AS sum_brate,
        {whole("l.ord + 1")} AS ord FROM dose
        JOIN (SELECT * FROM {listed(fv.DOSE_ORDER, "name")}) l ON l.name = dose.delay_bucket""",
    "dash_monthly_series": """SELECT purchase_month, brr AS sum_brr, dr AS sum_dr,
        "asc" AS sum_asc FROM monthly""",
    "dash_risk_matrix": f"""
        SELECT product_category_name_english, dr AS sum_dr, brr AS sum_brr, lift AS sum_lift,
          "to" AS sum_to,
          CASE WHEN dr > {fv.PARAM_DELAY_RATE} THEN 'late' ELSE 'punctual' END || '/' ||
          CASE WHEN brr > {fv.PARAM_BAD_RATE} THEN 'bad' ELSE 'good' END AS quadrant
        FROM category_risk""",
}

_GMV_COLUMNS = (
    "category_en, n_items, CAST(gmv AS DOUBLE) AS gmv, "
    + num("mean_price")
    + " AS mean_price, CAST(freight AS DOUBLE) AS freight, freight_pct, mean_freight"
)
RAW["eda_category_gmv"] = f"SELECT {_GMV_COLUMNS} FROM category_gmv"
RAW["eda_category_top_gmv"] = (
    f"SELECT {_GMV_COLUMNS} FROM category_gmv ORDER BY category_gmv.gmv DESC, category_en LIMIT 10"
)
RAW["eda_category_top_freight"] = (
    f"SELECT {_GMV_COLUMNS} FROM category_gmv ORDER BY freight_pct DESC, category_en LIMIT 15"
)


def _melted(rollup: str, query: str) -> str:
    """A roll-up's numbers, one per row."""
    names = [c.split()[0].strip("`") for c in ROLLUPS[rollup].split(", ")]
    key, *numbers = [c for c in names if c != "format"]
    casts = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in numbers)
    columns = ", ".join(f'"{c}"' for c in numbers)
    return f"""SELECT '{rollup}' AS rollup, key, metric, value FROM (
        UNPIVOT (SELECT "{key}" AS key, {casts} FROM ({RAW[query]})) ON {columns}
        INTO NAME metric VALUE value)"""


RAW["read_rollups"] = " UNION ALL ".join(
    _melted(name, query)
    for name, query in {
        "kpi_summary": "rollup_kpi",
        "monthly_trend": "rollup_monthly",
        "delay_dose": "rollup_delay_dose",
        "group_compare": "rollup_group_compare",
        "category_risk": "rollup_category_risk",
        "payment": "rollup_payment",
    }.items()
)


def oracle_sql() -> dict[str, str]:
    return {name: _with_parts_nested(sql) for name, sql in RAW.items()}
