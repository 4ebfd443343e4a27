"""Fixture views over the driver tables: one portable SELECT per view.

The same text runs in Spark SQL and DuckDB. ``iso(ts, k)`` stands for "ts plus k % 24 hours as
an ISO string", the only spot where the two dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from dealweave.session import prepare

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "v_emails": """
SELECT o.o_orderkey AS email_idx,
  CASE CAST(o.o_orderkey % 6 AS INT)
    WHEN 0 THEN concat('RE: Project ', c.c_mktsegment, ' - Purchase Agreement revised draft')
    WHEN 1 THEN concat('FW: [EXT] [', c.c_mktsegment, ' Deal] Disclosure Schedule')
    WHEN 2 THEN concat('Escrow Agreement execution version ', CAST(o.o_custkey % 40 AS STRING))
    WHEN 3 THEN concat('Re: RE: Matter: ', lower(c.c_mktsegment), ' closing | officer certificate')
    WHEN 4 THEN 'Closing call'
    ELSE '' END AS subject,
  concat(c.c_name, ' <C', CAST(c.c_custkey AS STRING), '@', c.c_mktsegment, '.example.com>') AS sender,
  concat('deal', CAST(o.o_custkey % 50 AS STRING), '@firm.example.com; Buyer Counsel <bc', CAST(o.o_orderkey % 7 AS STRING), '@buyer.example.net>') AS recipients,
  CASE WHEN o.o_orderkey % 5 = 0 THEN 'Paralegal; paralegal ; Agent' ELSE '' END AS cc,
  concat(
    CASE CAST(o.o_orderkey % 7 AS INT)
      WHEN 0 THEN 'Attached is the revised draft. Open issue: the rent cap is still in brackets.'
      WHEN 1 THEN 'Please review and comment on the attached markup. The parking annex is missing, please confirm it!'
      WHEN 2 THEN 'The agreement has been fully executed. Signature pages attached.'
      WHEN 3 THEN 'Agreed form, no further comments.'
      WHEN 4 THEN 'Sent to opposing counsel for review; see Übersicht\u00a0Anlage v2.docx and Funds Flow.xlsx'
      WHEN 5 THEN 'First draft attached.'
      ELSE 'FYI only.' END,
    CASE WHEN o.o_orderkey % 3 = 0 THEN concat(chr(10), chr(10), 'On Fri, Seller Counsel wrote:', chr(10), '> older text about escrow executed copy') ELSE '' END,
    CASE WHEN o.o_orderkey % 11 = 0 THEN concat(chr(10), 'PRIVILEGED AND CONFIDENTIAL', chr(10), 'boilerplate') ELSE '' END) AS body,
  CASE CAST(o.o_orderkey % 4 AS INT)
    WHEN 0 THEN concat(c.c_mktsegment, '_Purchase-Agreement_v', CAST(o.o_orderkey % 9 AS STRING), '.docx; Disclosure Schedule.pdf')
    WHEN 1 THEN 'Escrow Agreement (execution version).pdf'
    ELSE '' END AS attachments,
  CASE WHEN o.o_orderstatus = 'O' THEN iso(o.o_orderdate, o.o_orderkey) ELSE '' END AS date_sent,
  CASE WHEN o.o_orderstatus <> 'O' THEN iso(o.o_orderdate, o.o_orderkey) ELSE '' END AS date_received,
  CASE WHEN o.o_orderkey % 4 = 0 THEN concat('CONV-', CAST(o.o_custkey AS STRING)) ELSE '' END AS conversation_id,
  CASE WHEN o.o_orderstatus = 'O' THEN 'Sent Items' ELSE 'Inbox' END AS root_folder
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""",
    "v_calendar": """
SELECT event_id, user_id,
  CASE event_type WHEN 'click' THEN concat('[Project ', CAST(user_id % 12 AS STRING), '] all hands')
                  WHEN 'view' THEN concat('Re: Deal ', CAST(user_id % 8 AS STRING), ' - status call')
                  WHEN 'signup' THEN concat('Matter: Fund ', CAST(user_id % 5 AS STRING), ' | kickoff')
                  ELSE 'Lunch' END AS summary,
  ts AS start_ts, CAST(floor(value) AS INT) AS duration_minutes
FROM events
""",
    "v_checklist": """
SELECT CAST(p_partkey % 20 AS BIGINT) AS checklist_id, p_partkey AS row_id,
  CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'CLOSING DELIVERABLES:' WHEN 1 THEN 'Purchase Agreement'
    WHEN 2 THEN '1. Representations and Warranties' WHEN 3 THEN 'Escrow Agreement' WHEN 4 THEN 'TBD'
    WHEN 5 THEN concat(p_name, ' Side Letter') WHEN 6 THEN 'Disclosure  Schedule' ELSE '' END AS document_name,
  CASE CAST(p_size % 8 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'Pending Draft' WHEN 2 THEN 'With Opposing Counsel'
    WHEN 3 THEN 'Agreed form' WHEN 4 THEN 'Fully executed' WHEN 5 THEN 'awaiting signature' WHEN 6 THEN 'circulated'
    ELSE 'on hold' END AS status,
  p_brand AS party, CASE WHEN p_partkey % 3 = 0 THEN 'Borrower, Agent and Lenders' ELSE 'Company; Holdings' END AS signatories,
  CASE WHEN p_partkey % 9 = 0 THEN 'under review' ELSE '' END AS notes
FROM part
""",
    "v_pages": """
SELECT CAST(l_orderkey % 50 AS BIGINT) AS deal_id, l_orderkey AS doc_id, l_linenumber AS page_num,
  concat_ws('|', min(l_suppkey), min(l_partkey)) AS k,
  CASE CAST(l_linenumber % 4 AS INT)
    WHEN 1 THEN concat('SIGNATURE PAGE TO ', CASE WHEN l_orderkey % 2 = 0 THEN 'CREDIT AGREEMENT' ELSE 'GUARANTY AGREEMENT' END, chr(10),
        'BIRCHFIELD ', CAST(min(l_suppkey) AS STRING), ' ESTATES LLC', chr(10), 'By: ____________________________', chr(10),
        'Name: Rosa Lind', chr(10), 'Title: Managing Director')
    WHEN 2 THEN concat('BIRCHFIELD ', CAST(min(l_suppkey) AS STRING), ' ESTATES LLC', chr(10), 'By: __________________', chr(10), 'Name: __________________', chr(10), 'Title: ________')
    WHEN 3 THEN concat('SCHEDULE ', CAST(min(l_partkey) % 9 AS STRING), chr(10), 'List of items')
    ELSE 'Ordinary prose page without any cue.' END AS page_text
FROM lineitem GROUP BY l_orderkey, l_linenumber
""",
    # Tables on pages: a signature table on some pages, in one of two header vocabularies, and a price list on others.
    "v_page_tables": """
SELECT DISTINCT deal_id, doc_id, page_num, 0 AS table_no, 0 AS row_no,
  CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'Printed Name' WHEN 1 THEN 'Item' ELSE 'Company' END AS c0,
  CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'Sign here' WHEN 1 THEN 'Price' ELSE 'Signature' END AS c1
FROM v_pages WHERE doc_id % 5 = 0 AND page_num % 4 IN (0, 2)
UNION ALL
SELECT DISTINCT deal_id, doc_id, page_num, 0, 1, concat('Pilar  Lind', chr(10), 'Vargas'), '' FROM v_pages WHERE doc_id % 5 = 0 AND page_num % 4 IN (0, 2)
UNION ALL
SELECT DISTINCT deal_id, doc_id, page_num, 0, 2, CASE WHEN doc_id % 2 = 0 THEN 'Harbor Lane LLC' ELSE '' END, '____' FROM v_pages WHERE doc_id % 5 = 0 AND page_num % 4 IN (0, 2)
UNION ALL
SELECT DISTINCT deal_id, doc_id, page_num, 1, 0, 'Name', 'Signature' FROM v_pages WHERE doc_id % 10 = 0 AND page_num % 4 = 0
""",
    "v_signed_pages": """
SELECT deal_id, doc_id + 10000000 AS signed_doc_id, page_num,
  concat('DocuSign Envelope ID: 77AA55CC33EE11BB', chr(10), 'Completed by DocuSign', chr(10),
         replace(page_text, 'By: ____________________________', 'By: /s/ Rosa Lind')) AS page_text
FROM v_pages WHERE doc_id % 3 = 0 AND page_num % 4 IN (1, 3)
""",
    "v_table_orig": """
SELECT p_partkey % 10 AS table_id,
  row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY p_partkey) AS row_idx,
  CAST(p_partkey AS STRING) AS c0, p_name AS c1, p_brand AS c2, CAST(p_size AS STRING) AS c3
FROM part
""",
    "v_table_mod": """
SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY pos, c0) AS row_idx, c0, c1, c2, c3
FROM (
  SELECT p_partkey % 10 AS table_id, CASE WHEN p_partkey % 10 = 5 THEN -p_partkey ELSE p_partkey END AS pos,
    CAST(p_partkey AS STRING) AS c0, p_name AS c1, p_brand AS c2,
    CASE WHEN p_partkey % 13 = 0 THEN concat(CAST(p_size AS STRING), ' rev') ELSE CAST(p_size AS STRING) END AS c3
  FROM part WHERE p_partkey % 17 <> 0
  UNION ALL
  SELECT p_partkey % 10, p_partkey, concat('NEW', CAST(p_partkey AS STRING)), 'inserted row', p_brand, '0'
  FROM part WHERE p_partkey % 29 = 0
) u
""",
    "v_usage": """
SELECT event_id, ts AS event_ts, user_id, event_type AS feature,
  CAST(floor(value) AS INT) % 10 AS input_count,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS INT) % 10 END AS output_count,
  CAST(floor(value * 100) AS BIGINT) AS duration_ms, props
FROM events
""",
    "v_identities": """
SELECT c_custkey AS ident_id, lower(concat('c', CAST(c_custkey AS STRING), '@', c_mktsegment, '.example.com')) AS email,
  concat('user', CAST(c_custkey % 97 AS STRING)) AS username, concat('uid-', CAST(c_custkey AS STRING)) AS user_id
FROM customer
""",
    "v_policy_rules": """
SELECT * FROM (VALUES
  ('blocked_emails', 'c7@building.example.com'), ('blocked_domains', '.household.example.com'),
  ('blocked_domains', 'machinery.example.com'), ('blocked_users', 'user13'),
  ('allowed_domains', '*.example.com'), ('allowed_domains', 'furniture.example.com'),
  ('allowed_domains', 'building.example.com'), ('allowed_emails', '*@automobile.example.com'),
  ('admin_users', 'uid-42'), ('admin_emails', 'c100')) AS t(list_name, entry)
""",
    "v_incumbency": """
SELECT concat('BIRCHFIELD ', CAST(s_suppkey % 20 AS STRING), ' Estates, LLC') AS entity_name, s_suppkey AS row_idx,
  CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'Rosa Lind - President' WHEN 1 THEN 'John Smith'
       WHEN 2 THEN 'Birchfield Estates LLC' ELSE 'Mary Ann Jones, Secretary' END AS cell0,
  CASE WHEN s_suppkey % 4 = 1 THEN 'Vice President' ELSE '' END AS cell1
FROM supplier
""",
    "v_track_changes": """
SELECT l_orderkey % 100 AS base_doc_id, concat('Reviewer ', CAST(l_suppkey % 5 AS STRING)) AS author,
  CASE l_returnflag WHEN 'A' THEN 'insertion' WHEN 'R' THEN 'deletion' ELSE 'comment' END AS change_type,
  l_shipdate AS change_ts, CASE WHEN l_returnflag IN ('A','R') THEN l_linenumber ELSE NULL END AS paragraph_index,
  CASE WHEN l_quantity < 3 THEN '' ELSE concat('text ', CAST(l_partkey AS STRING)) END AS change_text
FROM lineitem
""",
    # Further views of our own, same rules: checklist rows with blank cells on header rows,
    # unlabeled grids with a title row and one of two header vocabularies, model decisions as text.
    "v_rows": """
SELECT checklist_id, row_id, document_name,
  CASE WHEN document_name LIKE '%:' OR row_id % 8 = 2 THEN '' ELSE status END AS status,
  CASE WHEN document_name LIKE '%:' OR row_id % 8 = 2 THEN '' ELSE party END AS party,
  CASE WHEN document_name LIKE '%:' OR row_id % 8 = 2 THEN '' ELSE signatories END AS signatories, notes
FROM v_checklist
""",
    "v_grid": """
SELECT checklist_id % 10 AS file_id, checklist_id AS table_id, 0 AS row_idx, 'Closing list' AS c0, '' AS c1, '' AS c2, '' AS c3, '' AS c4
FROM (SELECT DISTINCT checklist_id FROM v_rows) a
UNION ALL
SELECT checklist_id % 10, checklist_id, 1,
  CASE WHEN checklist_id % 3 = 0 THEN 'Document' WHEN checklist_id % 3 = 1 THEN 'Deliverable' ELSE 'Name' END,
  CASE WHEN checklist_id % 3 = 0 THEN 'Status' WHEN checklist_id % 3 = 1 THEN 'State' ELSE 'Progress' END,
  CASE WHEN checklist_id % 2 = 0 THEN 'Party' ELSE 'Who' END, 'Signatories', CASE WHEN checklist_id % 2 = 0 THEN 'Notes' ELSE 'Remarks' END
FROM (SELECT DISTINCT checklist_id FROM v_rows) b
UNION ALL
SELECT checklist_id % 10, checklist_id, CAST(1 + row_number() OVER (PARTITION BY checklist_id ORDER BY row_id) AS INT),
  document_name, status, party, signatories, notes
FROM v_rows
""",
    "v_decisions": """
SELECT checklist_id, row_id, concat(
  CASE CAST(row_id % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN concat('```json', chr(10)) ELSE 'Here is the result: ' END,
  '{"matches": [{"row_id": "', CAST(row_id AS STRING), '", "document_name": "', document_name,
  '", "status": "', CASE CAST(row_id % 5 AS INT) WHEN 0 THEN 'fully executed' WHEN 1 THEN 'Agreed Form' WHEN 2 THEN 'unclear' WHEN 3 THEN 'under review' ELSE '' END,
  '", "has_activity": "', CASE CAST(row_id % 4 AS INT) WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END,
  '", "matching_email_indices": [', CAST(row_id % 7 - 1 AS STRING), ', 5], "matching_thread_ids": ["thread-1", "thread-', CAST(row_id % 3 AS STRING),
  '"], "confidence": ', CAST(row_id % 4 AS STRING), '.25, "checklist_comment": "seen"}]}',
  CASE CAST(row_id % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN concat(chr(10), '```') ELSE ' Let me know.' END) AS payload
FROM v_rows WHERE row_id % 2 = 0
""",
}

_ISO = re.compile(r"iso\((\S+), (\S+?)\)")
_SOURCE = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(BASE_TABLES + tuple(VIEWS)) + r")\b")
_SPARK_ISO = (
    r"""date_format(\1 + make_interval(0,0,0,0,CAST(\2 % 24 AS INT),0,0), "yyyy-MM-dd'T'HH:mm:ss")"""
)
_DUCK_ISO = r"strftime(\1 + to_hours(CAST(\2 % 24 AS INT)), '%Y-%m-%dT%H:%M:%S')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a fixture view as a DataFrame."""
    prepare(spark)
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark_sql(spark, sf_dir, VIEWS[name])


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run portable SQL in Spark, binding every table it names as a DataFrame argument."""
    prepare(spark)
    names = sorted({m.group(2) for m in _SOURCE.finditer(text)})
    escaped = _ISO.sub(_SPARK_ISO, text).replace("{", "{{").replace("}", "}}")
    bound = _SOURCE.sub(r"\1 {\2}", escaped)
    return spark.sql(bound, **{n: table(spark, sf_dir, n) for n in names})


def duck_sql(text: str) -> str:
    """The same SQL for DuckDB: inline the views it needs as CTEs (base tables exist there)."""
    text = text.strip()
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", sql) and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(text)
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in needed]
    if re.match(r"WITH\b", text, re.I):
        body = re.sub(r"^WITH\b", "", text, count=1, flags=re.I)
        text = "WITH " + ",\n".join(ctes + [body.strip()]) if ctes else text
    elif ctes:
        text = "WITH " + ",\n".join(ctes) + "\n" + text
    return _ISO.sub(_DUCK_ISO, text)
