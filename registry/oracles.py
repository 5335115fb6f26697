"""SQL twins of the registered queries, for DuckDB on the same tables.

Written apart from the operators: they share only the source binding and the fixed country table.
"""

from __future__ import annotations

from ticketlens.operators.repair import COUNTRY_REGIONS
from ticketlens.plans.binding import CUSTOMERS_SQL, PLAIN_COLUMNS, TICKET_COLUMNS, tickets_sql

TABLES = {name: name for name in ("events", "documents", "benchmark", "customer")}
PLAIN = tickets_sql(False).format(**TABLES)
FULL = tickets_sql(True).format(**TABLES)
CUSTOMERS = CUSTOMERS_SQL.format(**TABLES)

# Fixed values, as in the operators.
NUM = r"(?i)\s*[+-]?(inf|infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\s*"
BLANK = r"\s\x{000B}\x{001C}-\x{001F}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}\x{0085}\x{1680}\x{202F}\x{205F}"
SENTIMENTS = "['very_negative', 'negative', 'neutral', 'positive', 'very_positive']"


def num(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '{NUM}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def time(c: str) -> str:
    return f"try_strptime({c}, '%Y-%m-%d %H:%M:%S')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def txt(c: str) -> str:
    return strip(f"coalesce({c}, '')")


def score(c: str) -> str:
    return f"CAST(trunc(CASE WHEN isfinite({num(c)}) THEN {num(c)} ELSE 0 END) AS BIGINT)"


def flag(c: str) -> str:
    return f"CASE WHEN ({num(c)}) > 0 OR lower({c}) = 'true' THEN 1 ELSE 0 END"


def hole(c: str) -> str:
    return f"({c} IS NULL OR lower({strip(c)}) IN ('', 'nan', 'unknown', 'none', 'nat'))"


def region_of(c: str) -> str:
    whens = " ".join(f"WHEN '{country}' THEN '{region}'" for country, region in COUNTRY_REGIONS.items())
    return f"CASE lower({strip(c)}) {whens} ELSE 'Unknown' END"


def clean(texts: bool = False) -> str:
    """CTEs ``src`` and ``clean``: the cleaned tickets."""
    columns = TICKET_COLUMNS if texts else PLAIN_COLUMNS
    typed = {
        "resolution_time_hours": num("resolution_time_hours"),
        "csat_score": score("csat_score"),
        "reopened": flag("reopened"),
        "has_attachment": flag("has_attachment"),
        "initial_message": txt("initial_message"),
        "agent_first_reply": txt("agent_first_reply"),
        "resolution_summary": txt("resolution_summary"),
    }
    keyed = ", ".join(f"{time(c)} AS {c}" if c == "created_at" else c for c in columns)
    final = ", ".join(f"{typed[c]} AS {c}" if c in typed else c for c in columns)
    return (
        f"src AS ({FULL if texts else PLAIN}), keyed AS (SELECT DISTINCT k, {keyed} FROM src), "
        f"clean AS (SELECT k, {final} FROM keyed)"
    )


CUST = (
    f"people AS ({CUSTOMERS}), cust AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER "
    "(PARTITION BY customer_id ORDER BY pos) AS rn FROM people) WHERE rn = 1)"
)
MARKED = (
    "marked AS (SELECT t.*, c.country, "
    f"{hole('t.region')} AS missing, {region_of('c.country')} AS mapped "
    "FROM clean t LEFT JOIN cust c ON t.customer_id = c.customer_id), "
    "fixed AS (SELECT * REPLACE (CASE WHEN missing THEN mapped ELSE region END AS region), "
    "missing AND mapped <> 'Unknown' AS imputed FROM marked)"
)
FACTORS = (
    "long AS (SELECT 'priority' AS factor, priority AS level, resolution_time_hours AS value FROM clean "
    "UNION ALL SELECT 'sla_plan', sla_plan, resolution_time_hours FROM clean "
    "UNION ALL SELECT 'region', region, resolution_time_hours FROM clean), "
    "fl AS (SELECT * FROM long WHERE level IS NOT NULL AND value IS NOT NULL)"
)
ORDER_FACTORS = (
    "fl AS (SELECT 'o_orderpriority' AS factor, o_orderpriority AS level, o_totalprice AS value FROM orders "
    "UNION ALL SELECT 'o_orderstatus', o_orderstatus, o_totalprice FROM orders)"
)
LIMIT = "CASE sla_plan WHEN 'standard' THEN 48 WHEN 'premium' THEN 24 WHEN 'gold' THEN 24 WHEN 'platinum' THEN 8 ELSE 48 END"
MONTH = "coalesce(strftime(created_at, '%Y-%m'), 'NaT')"
CLEANED_TEXT = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'http[^" + BLANK + r"]+', ' ', 'g'), "
    r"'[^a-z0-9" + BLANK + r"]', ' ', 'g'), '[" + BLANK + r"]+', ' ', 'g'))"
)
TERMS = (
    f"docs AS (SELECT doc_id, {CLEANED_TEXT} AS text FROM documents), "
    "words AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: length(x) >= 2) AS w FROM docs), "
    "gram AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), "
    "lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words), "
    "terms AS (SELECT doc_id, term, count(*) AS tf FROM gram GROUP BY ALL)"
)
VOCABULARY = (
    "voc AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df, "
    "ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf "
    "FROM terms GROUP BY term HAVING count(*) >= 5 ORDER BY total DESC, term LIMIT 2500)"
)
PREDICTED = (
    f"pred AS (SELECT k, customer_sentiment, {SENTIMENTS}[1 + (k + k % 3) % 5] AS predicted "
    "FROM clean WHERE customer_sentiment IS NOT NULL)"
)


def flat(c: str) -> str:
    return f"regexp_replace({strip(c)}, '[{BLANK}]+', ' ', 'g')"


def short(c: str, width: int) -> str:
    f = flat(c)
    cut = f"regexp_extract(substr({f}, 1, {width - 5}), '^(.*) [^ ]*$', 1, 's')"
    return f"CASE WHEN length({f}) <= {width} THEN {f} ELSE ltrim({cut} || ' [...]') END"


WIDE = (
    "wide AS (SELECT t.* EXCLUDE (k), c.* EXCLUDE (customer_id, pos) FROM clean t LEFT JOIN cust c ON t.customer_id = c.customer_id)"
)


def profile(blank: bool) -> str:
    numbers = ("created_at", "resolution_time_hours", "csat_score", "reopened", "has_attachment", "balance")
    parts = []
    for c in (*TICKET_COLUMNS, "name", "balance", "country"):
        test = f"{c} IS NULL"
        if blank and c not in numbers:
            test += f" OR {strip(c)} = ''"
        parts.append(
            f'SELECT \'{c}\' AS "column", count(*) FILTER ({test}) AS missing_count, '
            f"round(count(*) FILTER ({test}) / CAST(count(*) AS DOUBLE) * 100, 4) AS missing_percentage FROM wide"
        )
    return f"WITH {clean(True)}, {CUST}, {WIDE} " + " UNION ALL ".join(parts)


def described(source: str, columns: list[str], ctes: str = "") -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", round(CAST(count({c}) AS DOUBLE), 6) AS \"count\", round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS \"min\", "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS \"25%\", "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS \"50%\", "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS \"75%\", "
        f"round(CAST(max({c}) AS DOUBLE), 6) AS \"max\" FROM {source}"
        for c in columns
    ]
    return (f"WITH {ctes} " if ctes else "") + " UNION ALL ".join(parts)


LEVELS = (
    "SELECT factor, level, round(avg(value), 6) AS mean, round(median(value), 6) AS median, "
    "round(stddev_samp(value), 6) AS std, count(*) AS count FROM fl GROUP BY factor, level"
)
ANOVA = """, lv AS (SELECT factor, level, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM fl GROUP BY ALL),
ok AS (SELECT * FROM lv WHERE n >= 10),
gr AS (SELECT factor, sum(n * m) / sum(n) AS g FROM ok GROUP BY factor),
ss AS (SELECT f.factor, count(ok.n) AS groups, sum(ok.n) AS total, sum(ok.n * (ok.m - g) * (ok.m - g)) AS b,
  sum((ok.n - 1) * ok.v) AS w
  FROM (SELECT DISTINCT factor FROM lv) f LEFT JOIN ok ON ok.factor = f.factor LEFT JOIN gr ON gr.factor = f.factor
  GROUP BY f.factor)
SELECT factor, CASE WHEN groups >= 2 THEN round((b / (groups - 1)) / (w / (total - groups)), 6) END AS f,
  CASE WHEN groups >= 2 THEN CAST(groups - 1 AS DOUBLE) END AS df_between,
  CASE WHEN groups >= 2 THEN CAST(total - groups AS DOUBLE) END AS df_within, groups < 2 AS skipped FROM ss
"""

# The tail of the F density by Simpson's rule, from f in 40,000 steps as far as any weight is left.
P_VALUES = """WITH {ctes}, a AS ({anova}),
  z AS (SELECT factor, df_between AS p, df_within AS q, f, 120.0::DOUBLE / df_between AS reach FROM a WHERE NOT skipped),
  y AS (SELECT factor, reach, r.range AS i, CASE WHEN r.range IN (0, 40000) THEN 1 WHEN r.range % 2 = 1 THEN 4 ELSE 2 END AS wt,
      exp(lgamma((p + q) / 2) - lgamma(p / 2) - lgamma(q / 2) + (p / 2) * ln(p / q)
        + (p / 2 - 1) * ln(f + reach * r.range / 40000) - ((p + q) / 2) * ln(1 + p * (f + reach * r.range / 40000) / q)) AS d
    FROM z, range(40001) r),
  t AS (SELECT factor, sum(wt * d) * any_value(reach) / 40000 / 3 AS tail FROM y GROUP BY factor)
  SELECT a.factor, f, df_between, df_within, round(tail, 6) AS p_value, round(tail, 6) < 0.05 AS significant_05, skipped
  FROM a LEFT JOIN t ON a.factor = t.factor"""


def p_values(ctes: str) -> str:
    tested = ANOVA.replace("round((b / (groups - 1)) / (w / (total - groups)), 6)", "(b / (groups - 1)) / (w / (total - groups))")
    levels, final = tested.lstrip(", ").split("SELECT factor, CASE", 1)
    sql = P_VALUES.replace("{ctes}", f"{ctes}, {levels.strip()}").replace("{anova}", "SELECT factor, CASE" + final)
    return f"SELECT * REPLACE (round(f, 6) AS f) FROM ({sql})"


def histogram(where: str, value: str, bins: int) -> str:
    return f"""WITH {clean()}, v AS (SELECT CAST({value} AS DOUBLE) AS v FROM clean WHERE {where}),
    b AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
      CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v),
    c AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS BIGINT) AS bin, count(*) AS n
      FROM v, b GROUP BY 1)
    SELECT r.range AS bin, round(lo + r.range * ((hi - lo) / {bins}), 6) AS bin_start,
      round(lo + (r.range + 1) * ((hi - lo) / {bins}), 6) AS bin_end, coalesce(n, 0) AS n
    FROM range({bins}) r CROSS JOIN b LEFT JOIN c ON c.bin = r.range"""


def density(key: str | None, grid: int, bins: int | None) -> str:
    k = key or "'all'"
    scale = f"* any_value(n * (hi - lo)) / {bins}" if bins else ""
    shown = f"g AS {key}, " if key else ""
    return f"""WITH {clean()}, v AS (SELECT {k} AS g, resolution_time_hours AS v FROM clean
      WHERE resolution_time_hours IS NOT NULL AND {k} IS NOT NULL),
    s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, min(v) AS lo, max(v) AS hi,
      stddev_samp(v) * pow(count(*), -0.2) AS bw FROM v GROUP BY g),
    p AS (SELECT s.*, r.range AS point, lo + r.range * ((hi - lo) / {grid - 1}) AS x FROM s, range({grid}) r)
    SELECT {shown}point, round(any_value(x), 6) AS x,
      round(sum(exp(-pow((x - v.v) / bw, 2) / 2)) / any_value(n * bw * sqrt(2 * pi())) {scale}, 6)
      AS density
    FROM p JOIN v USING (g) GROUP BY g, point"""


def calendar(day: str) -> str:
    return (
        f"CAST(year({day}) * 10000 + month({day}) * 100 + day({day}) AS INTEGER) AS date_key, "
        f"CAST(year({day}) AS INTEGER) AS year, CAST(month({day}) AS INTEGER) AS month, "
        f"CAST(day({day}) AS INTEGER) AS day, dayname({day}) AS day_of_week"
    )


def days(source: str, column: str, ctes: str = "") -> str:
    return (
        (f"WITH {ctes} " if ctes else "")
        + f"SELECT CAST(d AS DATE) AS date, {calendar('d')} FROM (SELECT unnest(generate_series("
        f"CAST(min(CAST({column} AS DATE)) AS TIMESTAMP), CAST(max(CAST({column} AS DATE)) AS TIMESTAMP), "
        f"INTERVAL 1 DAY)) AS d FROM {source})"
    )


METRICS = f"""WITH {clean()}, {CUST}, {MARKED},
  resp AS (SELECT CASE WHEN csat_score > 0 THEN 1 ELSE 0 END AS r FROM clean),
  m AS (
    SELECT 'quality' AS stage, 'responded' AS metric, CAST(NULL AS VARCHAR) AS grp, CAST(sum(r) AS DOUBLE) AS value FROM resp
    UNION ALL SELECT 'quality', 'not_responded', NULL, count(*) FILTER (r = 0) FROM resp
    UNION ALL SELECT 'quality', 'response_rate', NULL, avg(r) FROM resp
    UNION ALL SELECT 'quality', 'missing_before', NULL, count(*) FILTER (missing) FROM fixed
    UNION ALL SELECT 'quality', 'imputed_from_country', NULL, count(*) FILTER (imputed) FROM fixed
    UNION ALL SELECT 'quality', 'set_unknown', NULL, count(*) FILTER (missing AND NOT imputed) FROM fixed
    UNION ALL SELECT 'quality', 'missing_after', NULL, count(*) FILTER ({hole('region')}) FROM fixed
    UNION ALL SELECT 'time', 'n', NULL, count(resolution_time_hours) FROM clean
    UNION ALL SELECT 'time', 'mean', NULL, avg(resolution_time_hours) FROM clean
    UNION ALL SELECT 'time', 'median', NULL, median(resolution_time_hours) FROM clean
    UNION ALL SELECT 'time', 'sla_rate', customer_segment,
      avg(CASE WHEN resolution_time_hours <= {LIMIT} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
      FROM clean WHERE resolution_time_hours IS NOT NULL AND customer_segment IS NOT NULL GROUP BY customer_segment
  )"""
REPLY_ROWS = f"""WITH {clean(True)}, use AS (SELECT *, 'Write a support agent reply. Priority: ' || coalesce(priority, 'nan')
    || '. Issue: ' || coalesce(issue_type, 'nan') || '. Customer: ' || {short('initial_message', 200)} AS prompt
  FROM clean WHERE agent_first_reply <> '' AND initial_message <> ''),
  r AS (SELECT ticket_id, prompt, {short('initial_message', 150)} AS customer_message,
    {short('agent_first_reply', 150)} AS actual_reply,
    'Thank you for reaching out about ' || coalesce(issue_type, 'your request') || '. We have logged your ticket as '
    || coalesce(priority, 'medium') || ' priority and a specialist will follow up shortly.' AS template FROM use)"""
REPORT = f"""WITH {clean()}, {PREDICTED}, cls AS (SELECT unnest({SENTIMENTS}) AS class),
  c AS (SELECT class, (SELECT count(*) FROM pred WHERE customer_sentiment = class AND predicted = class) AS tp,
    (SELECT count(*) FROM pred WHERE predicted = class) AS called,
    (SELECT count(*) FROM pred WHERE customer_sentiment = class) AS support FROM cls),
  p AS (SELECT *, CASE WHEN called > 0 THEN tp / CAST(called AS DOUBLE) ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall FROM c),
  f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p)
  SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / CAST(sum(support) AS DOUBLE), 6), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
    round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f"""
BOXES = f"""WITH {clean()}, {FACTORS},
  q AS (SELECT factor, level, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3 FROM fl GROUP BY ALL),
  j AS (SELECT fl.*, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
    FROM fl JOIN q USING (factor, level))
  SELECT factor, level, count(*) AS count, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
    round(any_value(q3), 6) AS q3, round(least(min(value) FILTER (inside), any_value(q1)), 6) AS whisker_low,
    round(greatest(max(value) FILTER (inside), any_value(q3)), 6) AS whisker_high,
    count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY factor, level"""

C = f"WITH {clean()} "
P = f"WITH src AS ({PLAIN}) "
SEGMENT_RATE = (
    f"round(avg(CASE WHEN resolution_time_hours <= {LIMIT} THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS sla_rate"
)
FACT = ", ".join(
    "CAST(year(created_at) * 10000 + month(created_at) * 100 + day(created_at) AS INTEGER) AS date_key"
    if c == "date_key" else c
    for c in (
        "ticket_id", "customer_id", "date_key", "priority", "status", "sla_plan", "channel", "product_area",
        "issue_type", "resolution_time_hours", "reopened", "customer_sentiment", "csat_score", "has_attachment",
        "platform", "region",
    )
)
MATRIX = ", ".join(
    f"count(*) FILTER (predicted = '{s}') AS {s}"
    for s in ("negative", "neutral", "positive", "very_negative", "very_positive")
)

# The words pandas reads as missing.
PANDAS_WORDS = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', "
                "'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")


def csv_scan(words: str) -> str:
    columns = ", ".join(f"CASE WHEN {c} NOT IN ({words}) THEN {c} END AS {c}" for c in TICKET_COLUMNS)
    return f"WITH src AS ({FULL}) SELECT {columns} FROM src"


CATEGORIES = ("priority", "channel", "product_area", "region", "customer_segment")


def slot(c: str) -> str:
    """Zero-based place of a value among the sorted distinct values, missing as one of them."""
    return f"dense_rank() OVER (ORDER BY coalesce({c}, '(missing)')) - 1"


ORACLES: dict[str, str] = {
    "s01_csv_scan": csv_scan("''"),
    "s01_csv_scan_pandas_words": csv_scan(PANDAS_WORDS),
    "m03_one_hot": C + "SELECT ticket_id, " + ", ".join(f"{slot(c)} AS {c}_slot" for c in CATEGORIES) + ", "
                   + ", ".join(f"(SELECT CAST(count(DISTINCT coalesce({c}, '(missing)')) AS INTEGER) FROM clean) AS {c}_size"
                               for c in CATEGORIES) + " FROM clean",
    "m04_features": f"""WITH {TERMS}, {VOCABULARY},
        pos AS (SELECT term, idf, row_number() OVER (ORDER BY total DESC, term) - 1 AS position FROM voc),
        w AS (SELECT doc_id, position, tf * idf AS w FROM terms JOIN pos USING (term)),
        nv AS (SELECT count(*) AS n FROM voc), nl AS (SELECT count(DISTINCT lang) AS n FROM documents)
        SELECT doc_id, CAST(position AS INTEGER) AS position,
          round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM w
        UNION ALL SELECT doc_id, CAST((SELECT n FROM nv) + dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER), 1.0 FROM documents
        UNION ALL SELECT doc_id, CAST((SELECT n FROM nv) + (SELECT n FROM nl) + dense_rank() OVER (ORDER BY source) - 1 AS INTEGER),
          1.0 FROM documents""",
    "s02_pruned_scan": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 200000.0",
    "s04_optional_columns": f"SELECT customer_id, country FROM ({CUSTOMERS})",
    "s06_metric_rows": f"{METRICS} SELECT stage, metric, grp, round(value, 6) AS value FROM m",
    "s03_required_columns": "SELECT * FROM customer",
    "s05_write_table": C + f"SELECT {', '.join(PLAIN_COLUMNS)} FROM clean",
    "s05_replace_table": C + f"SELECT {', '.join(PLAIN_COLUMNS)} FROM clean WHERE resolution_time_hours IS NOT NULL",
    "f07_enough_rows": C + "SELECT n AS needed, (SELECT count(*) FROM clean WHERE csat_score > 0) >= n AS enough "
                           "FROM unnest([1::BIGINT, 200, 1000000000]) AS t(n)",
    "s07_metrics_by_stage": f"""{METRICS} SELECT metric, grp, round(max(value) FILTER (stage = 'quality'), 6) AS quality,
        round(max(value) FILTER (stage = 'time'), 6) AS time FROM m GROUP BY metric, grp""",
    "p01_id_text": P + "SELECT CAST(k AS VARCHAR) AS ticket_id, customer_id, "
                       "coalesce(customer_id, 'nan') AS customer_id_matching FROM src",
    "p02_time": P + f"SELECT ticket_id, {time('created_at')} AS created_at, "
                    f"coalesce(try_strptime(created_at, '%Y-%m-%d'), {time('created_at')}) AS created_any FROM src",
    "p03_number": P + f"SELECT ticket_id, {num('resolution_time_hours')} AS resolution_time_hours, "
                      f"CASE WHEN ({num('resolution_time_hours')}) IS NOT NULL THEN "
                      "TRY_CAST(resolution_time_hours || 'e1' AS DOUBLE) END AS scaled, "
                      "CAST(NULL AS DOUBLE) AS suffixed FROM src",
    "p04_score": P + f"SELECT ticket_id, {score('csat_score')} AS csat_score FROM src",
    "p05_binary_flag": P + f"SELECT ticket_id, {flag('reopened')} AS reopened, "
                           f"{flag('has_attachment')} AS has_attachment FROM src",
    "p06_text_strip": f"WITH src AS ({FULL}) SELECT ticket_id, {txt('initial_message')} AS initial_message, "
                      f"{txt('agent_first_reply')} AS agent_first_reply, "
                      f"{txt('resolution_summary')} AS resolution_summary FROM src",
    "p07_date_key": C + "SELECT ticket_id, CAST(year(created_at) * 10000 + month(created_at) * 100 + "
                        "day(created_at) AS INTEGER) AS date_key FROM clean",
    "p08_calendar_parts": f"SELECT o_orderkey, {calendar('o_orderdate')} FROM orders",
    "p09_month_bucket": C + f"SELECT ticket_id, {MONTH} AS month FROM clean",
    "p10_response_flag": C + "SELECT ticket_id, csat_score, CASE WHEN csat_score > 0 THEN 1 ELSE 0 END AS csat_response FROM clean",
    "p11_fact": C + f"SELECT {FACT} FROM clean",
    "p12_country_region": f"SELECT pos, country, {region_of('country')} AS region FROM ({CUSTOMERS})",
    "p13_sla_limit": C + f"SELECT ticket_id, sla_plan, resolution_time_hours, {LIMIT} AS sla_limit, "
                         f"resolution_time_hours <= {LIMIT} AS sla_met FROM clean WHERE resolution_time_hours IS NOT NULL",
    "p14_join_texts": f"WITH src AS ({FULL}) SELECT ticket_id, "
                      + strip("coalesce(initial_message, '') || ' ' || coalesce(agent_first_reply, '')") + " AS text FROM src",
    "p15_log_target": C + "SELECT ticket_id, round(ln(1 + resolution_time_hours), 6) AS log_hours, "
                          "round(resolution_time_hours, 6) AS hours_again FROM clean",
    "p16_normalise": f"SELECT doc_id, {CLEANED_TEXT} AS text FROM documents",
    "p17_shorten": f"SELECT doc_id, {short('text', 200)} AS short_200, {short('text', 150)} AS short_150 FROM documents",
    "p18_template_reply": C + "SELECT ticket_id, 'Thank you for reaching out about ' || coalesce(product_area, 'your request') "
                              "|| '. We have logged your ticket as ' || coalesce(sla_plan, 'medium') || "
                              "' priority and a specialist will follow up shortly.' AS reply FROM clean",
    "p19_prompt": "SELECT conv_id, turn, 'Write a support agent reply. Priority: ' || role || '. Issue: nan. Customer: ' "
                  f"|| {short('text', 200)} AS prompt FROM conversations",
    "p20_rename_reorder": f"SELECT country AS country_dim, customer_id, name FROM ({CUSTOMERS})",
    "f01_have_value": C + "SELECT ticket_id, resolution_time_hours, customer_sentiment FROM clean "
                          "WHERE resolution_time_hours IS NOT NULL AND customer_sentiment IS NOT NULL",
    "f02_respondents": C + "SELECT ticket_id, csat_score FROM clean WHERE csat_score > 0",
    "f02_respondents_by_score": C + "SELECT ticket_id, csat_score FROM clean WHERE csat_score > 0",
    "f03_needs_fill": P + f"SELECT ticket_id, region, {hole('region')} AS needs_fill FROM src",
    "f04_closed_without_text": P + "SELECT ticket_id, status, resolution_summary FROM src WHERE lower(status) IN "
                                   "('resolved', 'closed_no_action') AND (resolution_summary IS NULL OR "
                                   f"{strip('resolution_summary')} = '')",
    "f05_longer_than": "SELECT conv_id, turn FROM conversations WHERE length(text) > 400",
    "f06_group_size": C + "SELECT 'customer_id' AS factor, customer_id AS level, count(*) AS count FROM clean "
                          "WHERE customer_id IS NOT NULL AND resolution_time_hours IS NOT NULL GROUP BY customer_id "
                          "HAVING count(*) >= 10 UNION ALL SELECT 'priority', priority, count(*) FROM clean "
                          "WHERE priority IS NOT NULL AND resolution_time_hours IS NOT NULL GROUP BY priority "
                          "HAVING count(*) >= 10",
    "u01_impute_region": f"WITH {clean()}, {CUST}, {MARKED} SELECT ticket_id, customer_id, region FROM fixed",
    "u02_fill_summary": C + "SELECT ticket_id, status, CASE WHEN lower(status) IN ('resolved', 'closed_no_action') AND "
                            "resolution_summary = '' THEN 'No summary provided' ELSE resolution_summary END "
                            "AS resolution_summary FROM clean",
    "u02_fill_count": C + "SELECT count(*) FILTER (lower(status) IN ('resolved', 'closed_no_action') AND "
                          "resolution_summary = '') AS resolution_summary_filled FROM clean",
    "j01_left_enrich": f"WITH {clean()}, {CUST} SELECT ticket_id, t.customer_id, name, balance, country, region "
                       "FROM clean t LEFT JOIN cust c ON t.customer_id = c.customer_id",
    "j01_orders_enrich": "SELECT o_orderkey, o_custkey AS c_custkey, c_name, c_mktsegment FROM orders "
                         "LEFT JOIN customer ON o_custkey = c_custkey",
    "j02_lookup_fill": f"WITH {clean()}, {CUST} SELECT ticket_id, coalesce(CASE WHEN k % 3 = 0 THEN 'France' END, "
                       "c.country) AS country FROM clean t LEFT JOIN cust c ON t.customer_id = c.customer_id",
    "j03_lookup_first": f"WITH {clean()}, o AS (SELECT ticket_id, any_value(created_at) AS created_at, "
                        "any_value(customer_segment) AS customer_segment FROM src GROUP BY ticket_id) "
                        "SELECT clean.ticket_id, priority, o.created_at, o.customer_segment FROM clean LEFT JOIN o USING (ticket_id)",
    "j04_dictionary_default": P + f"SELECT ticket_id, sla_plan, CAST({LIMIT} AS BIGINT) AS sla_limit FROM src",
    "j05_key_coverage": f"WITH {clean()}, {CUST}, ids AS (SELECT DISTINCT customer_id FROM clean WHERE customer_id IS NOT NULL) "
                        "SELECT count(*) AS distinct_keys, count(c.customer_id) AS matched_keys, "
                        "count(*) - count(c.customer_id) AS orphan_keys FROM ids LEFT JOIN cust c USING (customer_id)",
    "j05_orphan_keys": f"WITH {clean()}, {CUST} SELECT DISTINCT customer_id FROM clean WHERE customer_id IS NOT NULL "
                       "AND customer_id NOT IN (SELECT customer_id FROM cust)",
    "d01_drop_exact": f"WITH src AS ({FULL}) SELECT DISTINCT {', '.join(TICKET_COLUMNS)} FROM src",
    "d01_drop_exact_in_place": "SELECT DISTINCT source, lang, n_chars, text FROM documents",
    "d01_exact_copies": f"WITH src AS ({FULL}), u AS (SELECT DISTINCT {', '.join(TICKET_COLUMNS)} FROM src) "
                        "SELECT (SELECT count(*) FROM src) AS rows_before, count(*) AS rows_after, "
                        "(SELECT count(*) FROM src) - count(*) AS rows_dropped FROM u",
    "d01_clean_tickets": C + f"SELECT {', '.join(PLAIN_COLUMNS)} FROM clean",
    "d02_keep_first": f"WITH {CUST} SELECT * FROM cust",
    "d02_first_per_user": "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER "
                          "(PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
    "d03_duplicate_keys": f"SELECT customer_id, count(*) AS n_rows, count(*) - 1 AS n_removed FROM ({CUSTOMERS}) "
                          "GROUP BY customer_id HAVING count(*) > 1",
    "d03_duplicate_summary": f"WITH n AS (SELECT count(*) AS n FROM ({CUSTOMERS}) GROUP BY customer_id) "
                             "SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, "
                             "CAST(sum(n - 1) AS BIGINT) AS rows_removed, count(*) FILTER (n > 1) AS repeated_keys FROM n",
    "d04_dim_channel": C + "SELECT CAST(row_number() OVER (ORDER BY channel) AS INTEGER) AS channel_key, "
                           "channel AS channel_name FROM (SELECT DISTINCT channel FROM clean WHERE channel IS NOT NULL)",
    "d04_dim_product_area": C + "SELECT CAST(row_number() OVER (ORDER BY product_area) AS INTEGER) AS product_area_key, "
                                "product_area AS product_area_name FROM (SELECT DISTINCT product_area FROM clean "
                                "WHERE product_area IS NOT NULL)",
    "d04_dim_part": "SELECT CAST(row_number() OVER (ORDER BY p_name) AS INTEGER) AS part_key, p_name AS part_name "
                    "FROM (SELECT DISTINCT p_name FROM part)",
    "d05_label_list": C + "SELECT DISTINCT customer_sentiment FROM clean WHERE customer_sentiment IS NOT NULL ORDER BY 1",
    "a01_missing_profile": profile(False),
    "a01_missing_profile_blank": profile(True),
    "a02_describe": described("wide", ["resolution_time_hours", "reopened", "csat_score", "has_attachment", "balance"],
                              f"{clean()}, {CUST}, {WIDE}"),
    "a02_describe_lineitem": described("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "a03_group_stats": f"WITH {clean()}, {FACTORS} {LEVELS}",
    "a03_orders_by_priority": f"WITH {ORDER_FACTORS} {LEVELS}",
    "a04_overall": C + "SELECT count(resolution_time_hours) AS n, round(avg(resolution_time_hours), 6) AS mean, "
                       "round(median(resolution_time_hours), 6) AS median FROM clean",
    "a05_month_priority": C + f"SELECT {MONTH} AS month, priority, count(*) AS n FROM clean "
                              "WHERE priority IS NOT NULL GROUP BY 1, 2",
    "a06_cross_tab": C + f"SELECT {MONTH} AS month, count(*) FILTER (priority = 'urgent') AS urgent, "
                         "count(*) FILTER (priority = 'high') AS high, count(*) FILTER (priority = 'medium') AS medium, "
                         "count(*) FILTER (priority = 'low') AS low FROM clean WHERE priority IS NOT NULL GROUP BY 1",
    "a06_cross_tab_rest": C + f"SELECT {MONTH} AS month, count(*) FILTER (priority = 'urgent') AS urgent, "
                              "count(*) FILTER (priority = 'high') AS high, "
                              "count(*) FILTER (priority NOT IN ('urgent', 'high')) AS other "
                              "FROM clean WHERE priority IS NOT NULL GROUP BY 1",
    "a06_cross_tab_cells": C + f", n AS (SELECT {MONTH} AS month, priority, count(*) AS n FROM clean "
                              "WHERE priority IS NOT NULL GROUP BY 1, 2) SELECT month, '{' || string_agg("
                              "'\"' || priority || '\":' || n, ',' ORDER BY priority) || '}' AS cells FROM n GROUP BY 1",
    "a07_value_counts": C + "SELECT customer_sentiment, count(*) AS n FROM clean WHERE customer_sentiment IS NOT NULL "
                            "GROUP BY 1 ORDER BY n DESC, 1",
    "a08_sla_rate": C + f"SELECT customer_segment, {SEGMENT_RATE} FROM clean WHERE resolution_time_hours IS NOT NULL "
                        "AND customer_segment IS NOT NULL GROUP BY 1",
    "a09_histogram": histogram("resolution_time_hours IS NOT NULL", "resolution_time_hours", 40),
    "a09_csat_histogram": histogram("csat_score > 0", "csat_score", 5),
    "a10_density": density(None, 200, 40),
    "a11_density_by_priority": density("priority", 100, None),
    "a12_box_stats": BOXES,
    "a13_anova": p_values(f"{clean()}, {FACTORS}"),
    "a13_anova_orders": p_values(ORDER_FACTORS),
    "a13_anova_p_value": p_values(f"{clean()}, {FACTORS}"),
    "a13_anova_p_value_orders": p_values(ORDER_FACTORS),
    "a14_response_rate": C + "SELECT CAST(sum(CASE WHEN csat_score > 0 THEN 1 ELSE 0 END) AS BIGINT) AS responded, "
                             "count(*) FILTER (csat_score <= 0) AS not_responded, "
                             "round(avg(CASE WHEN csat_score > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS response_rate FROM clean",
    "a15_region_counters": f"WITH {clean()}, {CUST}, {MARKED} SELECT count(*) FILTER (missing) AS missing_before, "
                           "count(*) FILTER (imputed) AS imputed_from_country, "
                           "count(*) FILTER (missing AND NOT imputed) AS set_unknown, "
                           f"count(*) FILTER ({hole('region')}) AS missing_after FROM fixed",
    "a16_date_range": C + "SELECT min(CAST(created_at AS DATE)) AS min_date, max(CAST(created_at AS DATE)) AS max_date FROM clean",
    "a17_confusion_matrix": f"WITH {clean()}, {PREDICTED} SELECT customer_sentiment AS label, {MATRIX} FROM pred GROUP BY 1",
    "a17_confusion_matrix_rest": f"WITH {clean()}, {PREDICTED}, two AS (SELECT "
                                 + ", ".join(f"CASE WHEN {c} IN ('negative', 'positive') THEN {c} ELSE '(other)' END AS {a}"
                                             for c, a in (("customer_sentiment", "label"), ("predicted", "p")))
                                 + " FROM pred) SELECT label, "
                                 + ", ".join(f"count(*) FILTER (p = '{x}') AS \"{x}\"" for x in ("negative", "positive", "(other)"))
                                 + " FROM two GROUP BY label",
    "a17_confusion_cells": f"WITH {clean()}, {PREDICTED}, n AS (SELECT customer_sentiment AS label, predicted, count(*) AS n "
                           "FROM pred GROUP BY 1, 2) SELECT label, '{' || string_agg('\"' || predicted || '\":' || n, ',' "
                           "ORDER BY predicted) || '}' AS cells FROM n GROUP BY 1",
    "a18_classification_report": REPORT,
    "a19_regression_errors": C + ", e AS (SELECT resolution_time_hours AS y, resolution_time_hours * 0.9::DOUBLE + k % 7 AS p "
                                 "FROM clean WHERE resolution_time_hours IS NOT NULL) "
                                 "SELECT count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, "
                                 "round(avg(abs(y - p)), 6) AS mae, "
                                 "round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) AS r2 "
                                 "FROM e, (SELECT avg(y) AS m FROM e)",
    "o01_sort": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey",
    "o02_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "o03_sample": C + "SELECT ticket_id, priority FROM clean ORDER BY md5(ticket_id || ':42'), ticket_id LIMIT 500",
    "o04_calendar": days("clean", "created_at", clean()),
    "o04_calendar_orders": days("orders", "o_orderdate"),
    "o05_split": C + "SELECT ticket_id, CAST('0x' || substr(md5(ticket_id || ':42'), 1, 8) AS BIGINT) < "
                     "CAST(floor(0.2::DOUBLE * 4294967296) AS BIGINT) AS is_test FROM clean",
    "o05_split_stratified": C + "SELECT ticket_id, customer_sentiment, row_number() OVER (PARTITION BY customer_sentiment "
                                "ORDER BY md5(ticket_id || ':42'), ticket_id) <= ceil(0.2::DOUBLE * count(*) OVER "
                                "(PARTITION BY customer_sentiment)) AS is_test FROM clean WHERE customer_sentiment IS NOT NULL",
    "m01_terms": f"WITH {TERMS} SELECT doc_id, term, tf FROM terms",
    "m02_vocabulary": f"WITH {TERMS}, {VOCABULARY} SELECT term, total, df, round(idf, 6) AS idf FROM voc",
    "m02_tfidf_rows": f"WITH {TERMS}, {VOCABULARY}, w AS (SELECT doc_id, term, tf * idf AS w FROM terms JOIN voc USING (term)) "
                      "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w",
    "m08_class_weights": C + ", n AS (SELECT customer_sentiment, count(*) AS n FROM clean WHERE customer_sentiment IS NOT NULL "
                             "GROUP BY 1) SELECT customer_sentiment, n, round((SELECT sum(n) FROM n) / "
                             "CAST((SELECT count(*) FROM n) * n AS DOUBLE), 6) AS weight FROM n",
    "m08_weighted_rows": C + "SELECT ticket_id, round(count(*) OVER () / CAST((SELECT count(DISTINCT customer_sentiment) FROM clean) "
                             "* count(*) OVER (PARTITION BY customer_sentiment) AS DOUBLE), 6) AS class_weight "
                             "FROM clean WHERE customer_sentiment IS NOT NULL",
    "x02_reply_examples": f"{REPLY_ROWS}, s AS (SELECT * FROM r ORDER BY md5(ticket_id || ':42'), ticket_id LIMIT 6) "
                          "SELECT * EXCLUDE (template), template AS generated_reply, 'template' AS mode FROM s",
    "x02_all_replies": f"{REPLY_ROWS} SELECT * EXCLUDE (template), template AS generated_reply, 'template' AS mode FROM r",
    "x03_generated_replies": f"{REPLY_ROWS} SELECT * EXCLUDE (template), CASE WHEN length(prompt) % 2 = 0 THEN 'Reply to ' "
                             "|| length(prompt) || ' characters' ELSE template END AS generated_reply, "
                             "CASE WHEN length(prompt) % 2 = 0 THEN 'generated' ELSE 'template' END AS mode FROM r",
}

# Results that were written and read again.
ORACLES["m03_dictionary_slots"] = ORACLES["m03_one_hot"]
ORACLES["a09_dashboard"] = " UNION ALL ".join(
    f"SELECT '{panel}' AS panel, CAST({item} AS VARCHAR) AS item, CAST({value} AS DOUBLE) AS value FROM ({sql})"
    for panel, item, value, sql in (
        ("volume", "month || '|' || priority", "n", C + f"SELECT CAST({MONTH} AS VARCHAR) AS month, priority, count(*) AS n "
                                                       "FROM clean WHERE priority IS NOT NULL GROUP BY 1, 2"),
        ("channels", "channel", "n", C + "SELECT channel, count(*) AS n FROM clean WHERE channel IS NOT NULL GROUP BY 1"),
        ("sentiments", "customer_sentiment", "n", ORACLES["a07_value_counts"]),
        ("sla_by_segment", "customer_segment", "sla_rate", ORACLES["a08_sla_rate"]),
        ("resolution_histogram", "bin", "n", ORACLES["a09_histogram"]),
        ("csat_histogram", "bin", "n", ORACLES["a09_csat_histogram"]),
    )
)
ORACLES["s08_model_round_trip"] = ORACLES["m03_one_hot"]
ORACLES["s09_text_sink"] = f"SELECT reply AS value FROM ({ORACLES['p18_template_reply']})"
ORACLES["m10_batch_scoring"] = f"""WITH {TERMS}, {VOCABULARY},
    pos AS (SELECT term, idf, row_number() OVER (ORDER BY total DESC, term) - 1 AS position FROM voc),
    w AS (SELECT doc_id, position, tf * idf AS w FROM terms JOIN pos USING (term))
    SELECT doc_id, CAST(position AS INTEGER) AS position, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM w"""

# Checks of fitted models: their rows give what the models give, and the loss has no slope. Which rows there are is counted here.
HELD_OUT = ("SELECT ticket_id, true AS agrees FROM (SELECT ticket_id, row_number() OVER (ORDER BY md5(ticket_id || ':42'), ticket_id) AS r, "
            "count(*) OVER () AS n FROM clean WHERE {}) WHERE r <= ceil(0.2::DOUBLE * n)")
ORACLES["m05_scored_from_rows"] = C + HELD_OUT.format("csat_score > 0")
ORACLES["m06_scored_from_rows"] = C + HELD_OUT.format("resolution_time_hours IS NOT NULL")
ORACLES["m07_quality_optimal"] = ("SELECT CAST(quality AS VARCHAR) AS class, count(*) - CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS n_train, true AS optimal "
                                  "FROM documents JOIN labels USING (doc_id) WHERE length(text) > 5 AND quality IS NOT NULL GROUP BY quality")
ORACLES["m09_scored_from_rows"] = "SELECT doc_id, true AS agrees FROM documents"
