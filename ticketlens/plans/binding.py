"""Ticket- and customer-shaped source tables derived from the driver tables.

One SQL text that Spark and DuckDB both run.  Every event is a ticket, and
every document and benchmark text is used whole.  The tables hold, on purpose:
exact copies, unparsable dates and numbers, null ids, customers without a
master row, blank and null summaries, null-like regions, the literal region
``NA``, odd-case status and plan, null segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketlens.session import spread

TICKET_COLUMNS = [
    "ticket_id", "created_at", "customer_id", "customer_segment", "channel", "product_area",
    "issue_type", "priority", "status", "sla_plan", "initial_message", "agent_first_reply",
    "resolution_summary", "resolution_time_hours", "reopened", "customer_sentiment", "csat_score",
    "has_attachment", "platform", "region",
]
TEXT_COLUMNS = ["initial_message", "agent_first_reply"]
PLAIN_COLUMNS = [c for c in TICKET_COLUMNS if c not in TEXT_COLUMNS]

# Tickets without the two long texts: these need the events table only.
PLAIN_SQL = """
  SELECT e.event_id AS k,
    CAST(e.event_id AS STRING) AS ticket_id,
    CASE WHEN e.event_id % 101 = 0 THEN 'bad' ELSE CAST(date_trunc('second', e.ts) AS STRING) END AS created_at,
    CASE WHEN e.event_id % 997 = 0 THEN NULL
         WHEN e.event_id % 10 = 0 THEN CAST(e.user_id AS STRING)
         ELSE CAST(100000 + e.event_id % 9000 AS STRING) END AS customer_id,
    CASE e.event_id % 4 WHEN 0 THEN 'consumer' WHEN 1 THEN 'smb' WHEN 2 THEN 'enterprise' END AS customer_segment,
    e.event_type AS channel,
    CASE e.event_id % 8 WHEN 0 THEN 'analytics_dashboard' WHEN 1 THEN 'api_integration' WHEN 2 THEN 'billing'
         WHEN 3 THEN 'data_export' WHEN 4 THEN 'login_auth' WHEN 5 THEN 'mobile_app' WHEN 6 THEN 'notifications' END AS product_area,
    CASE e.event_id % 3 WHEN 0 THEN 'bug' WHEN 1 THEN 'how_to' ELSE 'outage' END AS issue_type,
    CASE WHEN e.event_id % 20 = 0 THEN 'urgent' WHEN e.event_id % 20 < 5 THEN 'high'
         WHEN e.event_id % 20 < 12 THEN 'medium' ELSE 'low' END AS priority,
    CASE e.event_id % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'Closed_No_Action' WHEN 2 THEN 'RESOLVED' ELSE 'open' END AS status,
    CASE e.event_id % 9 WHEN 0 THEN 'standard' WHEN 1 THEN 'premium' WHEN 2 THEN 'gold' WHEN 3 THEN 'platinum'
         WHEN 4 THEN 'Gold' WHEN 5 THEN NULL ELSE 'standard' END AS sla_plan,
    CASE WHEN e.event_id % 7 < 3 THEN '  ' WHEN e.event_id % 7 = 3 THEN NULL ELSE concat(' ', e.props, '  ') END AS resolution_summary,
    CASE WHEN e.event_id % 5 < 3 THEN CAST(e.value AS STRING) WHEN e.event_id % 5 = 3 THEN 'n/k' END AS resolution_time_hours,
    CASE e.event_id % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'yes' WHEN 3 THEN '-1' WHEN 4 THEN NULL ELSE '0' END AS reopened,
    CASE e.event_id % 6 WHEN 0 THEN 'very_negative' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral'
         WHEN 3 THEN 'positive' WHEN 4 THEN 'very_positive' END AS customer_sentiment,
    CASE WHEN e.event_id % 10 < 7 THEN CAST(1 + e.event_id % 5 AS STRING) WHEN e.event_id % 10 = 7 THEN '0'
         WHEN e.event_id % 10 = 8 THEN 'x' END AS csat_score,
    CASE WHEN e.event_id % 2 = 0 THEN '1' ELSE '0' END AS has_attachment,
    CASE e.event_id % 3 WHEN 0 THEN 'ios' WHEN 1 THEN 'web' ELSE 'android' END AS platform,
    CASE e.event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'EU' WHEN 2 THEN 'LATAM' WHEN 3 THEN ' Unknown '
         WHEN 4 THEN 'NA' ELSE 'APAC' END AS region
  FROM {events} e
"""

# The same tickets with a whole document as message and a whole benchmark text as reply.
FULL_SQL = """
  SELECT p.*, d.text AS initial_message,
    CASE WHEN p.k % 13 = 0 THEN NULL ELSE concat('  ', b.text, ' ') END AS agent_first_reply
  FROM (SELECT t.*, t.k % (SELECT count(*) FROM {documents}) AS doc_id,
               t.k % (SELECT count(*) FROM {benchmark}) AS item_id FROM (""" + PLAIN_SQL + """) t) p
  JOIN {documents} d ON d.doc_id = p.doc_id
  JOIN {benchmark} b ON b.item_id = p.item_id
"""

# One ticket in fifty comes twice.
TICKETS_SQL = """
  SELECT {columns} FROM ({body}) UNION ALL SELECT {columns} FROM ({body}) WHERE k % 50 = 0
"""

CUSTOMERS_SQL = """
  SELECT c_custkey AS pos, CAST(c_custkey AS STRING) AS customer_id, c_name AS name, c_acctbal AS balance,
    CASE c_nationkey % 8 WHEN 0 THEN 'Germany' WHEN 1 THEN ' brazil ' WHEN 2 THEN 'INDIA' WHEN 3 THEN 'USA'
      WHEN 4 THEN 'Egypt' WHEN 5 THEN 'Atlantis' WHEN 6 THEN NULL ELSE 'uk' END AS country
  FROM {customer}
  UNION ALL
  SELECT c_custkey + 10000000, CAST(c_custkey AS STRING), c_name, c_acctbal, 'Japan'
  FROM {customer} WHERE c_custkey % 25 = 0
"""


def tickets_sql(texts: bool) -> str:
    """Ticket query over the placeholders {events}, {documents} and {benchmark}."""
    columns = ", ".join(["k", *(TICKET_COLUMNS if texts else PLAIN_COLUMNS)])
    return TICKETS_SQL.replace("{columns}", columns).replace("{body}", FULL_SQL if texts else PLAIN_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_tickets(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """Raw tickets, all strings but the integer key ``k``; without the long texts if not wanted."""
    sources = {n: table(spark, sf_dir, n) for n in (["events", "documents", "benchmark"] if texts else ["events"])}
    if texts:
        sources["events"] = spread(sources["events"])
    return spark.sql(tickets_sql(texts), **sources)


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw customers with an order column and one in 25 ids twice."""
    return spark.sql(CUSTOMERS_SQL, customer=table(spark, sf_dir, "customer"))
