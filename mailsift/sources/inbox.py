"""The inbox: four raw mail sources derived from the given tables.

Each view turns whole tables into the raw shape of one source. The table text is the carrier;
depending on its length a tail with phrases, links, markup or broken encodings is appended, so
that every cleaning and feature operator has work to do. The SQL is portable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailsift.sources.merge import (
    conform_general_corpus,
    conform_mailbox,
    conform_spam_corpus,
    conform_synthetic,
    merge_sources,
)

PHISHING_TAIL = """CASE {n} % 13
  WHEN 0 THEN ' Act now! Verify your account immediately or your account will be suspended: http://192.168.10.5/login'
  WHEN 1 THEN ' URGENT: click here immediately (http://bit.ly/3xYzAb).'
  WHEN 2 THEN ' Final notice - respond within 24 hours: hxxp://secure-pay23x.tk/verify?id=9!'
  WHEN 3 THEN ' Unusual login activity. Confirm your identity at www.account-check.co.uk/restore, before its too late.'
  WHEN 4 THEN ' See http://trusted.example.com@evil-host.xyz/login and HTTPS://T.CO/abc!'
  WHEN 5 THEN ' Your prescription and LAB RESULTS are ready, the offer expires soon. Avoid suspension of your patient portal.'
  WHEN 6 THEN ' =?utf-8?B?VVJHRU5UIG5vdGljZQ==?= security alert http://login.x92kq7.ml./a'
  WHEN 7 THEN chr(10) || '<p>Dear <b>user</b>,<br>limited time &amp; last chance<a href="http://free-prize.ml/claim">claim &lt;here&gt; http://go.free-prize.ml/c</a></p>'
  WHEN 8 THEN ' cafÃ© urgently, urgent urgent'
  WHEN 9 THEN ' DO NOT IGNORE THIS! https://user:pw@mail.example.org:8443/x?u=http://a.b and https://999.9.9.9/q'
  WHEN 10 THEN ' Time-sensitive: www.pay-now.top/?next=http://bit.ly/q'
  ELSE '' END"""

LEGITIMATE_TAIL = """CASE {n} % 13
  WHEN 0 THEN ' Please review the patient chart and confirm the lab results.'
  WHEN 1 THEN ' The discharge summary and treatment plan are in the EHR, see https://portal.example.org/records/17.'
  WHEN 2 THEN chr(10) || 'diff --git a/x b/x' || chr(10) || '+++ b/x'
  WHEN 3 THEN ' To unsubscribe visit http://lists.example.net/mailman/listinfo/dev'
  WHEN 4 THEN ' cvs commit: checked in Revision 7'
  WHEN 5 THEN ' The corpus linguistics seminar covers noun phrases and morphology.'
  WHEN 6 THEN ' Use def main(args) or function run (x)'
  WHEN 7 THEN ' Meeting notes at www.example.com/notes'
  WHEN 8 THEN ' HIPAA training: appointment confirmation and health insurance questions'
  WHEN 9 THEN ' =?iso-8859-1?Q?R=E9sum=E9_attached?= thanks'
  WHEN 10 THEN ' broken char � kept'
  ELSE '' END"""

_IS_PHISHING = "(doc_id * 7919) % 1000 < 450"
_DOCUMENT_BODY = f"""text || CASE WHEN {_IS_PHISHING} AND (doc_id * 31) % 10 <> 0
  THEN {PHISHING_TAIL.format(n="n_chars")} ELSE {LEGITIMATE_TAIL.format(n="n_chars")} END"""
_DOCUMENT_TYPE = f"CASE WHEN {_IS_PHISHING} THEN 'Phishing Email' ELSE 'Safe Email' END"

RAW_SPAM_CORPUS = f"""
SELECT CAST((conv_id * 100000 + turn) * 2 AS BIGINT) AS message_no,
       CASE WHEN turn = 0 AND conv_id % 29 = 7 THEN 'N/A'
            WHEN turn = 0 AND conv_id % 31 = 5 THEN '   '
            WHEN turn = 0 AND conv_id % 37 = 3 THEN '<p> &nbsp; </p>'
            ELSE text || {LEGITIMATE_TAIL.format(n="length(text)")} END AS text,
       CASE WHEN conv_id % 6 = 0 THEN 0 ELSE 1 END AS label
FROM conversations
UNION ALL
SELECT CAST(item_id * 2 + 1 AS BIGINT), text, 1 FROM benchmark"""

RAW_MAILBOX = """
SELECT CAST(page_id AS BIGINT) AS message_no,
       CASE WHEN page_id % 5 = 0 THEN '' ELSE 'Notice about ' || url END AS subject,
       html AS body
FROM pages"""

RAW_GENERAL_CORPUS = f"""
SELECT CAST(doc_id * 2 AS BIGINT) AS message_no,
       CASE WHEN doc_id % 97 = 13 THEN NULL
            WHEN doc_id % 101 = 17 THEN ' Null '
            ELSE {_DOCUMENT_BODY} END AS email_text,
       {_DOCUMENT_TYPE} AS email_type
FROM documents WHERE doc_id % 5 <> 0
UNION ALL
SELECT CAST(item_id * 2 + 1 AS BIGINT), text, 'Safe Email' FROM benchmark"""

RAW_SYNTHETIC = f"""
SELECT CAST(doc_id AS BIGINT) AS message_no,
       {_DOCUMENT_TYPE} AS email_type,
       'topic_' || CAST(n_chars % 20 AS VARCHAR(10)) AS subcategory,
       CASE WHEN n_chars % 4 = 0 THEN NULL ELSE 'About your records' END AS subject,
       {_DOCUMENT_BODY} AS body
FROM documents WHERE doc_id % 5 = 0"""


TABLES = ("documents", "pages", "conversations", "benchmark")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {name: read_table(spark, sf_dir, name) for name in TABLES}

    def run(statement: str) -> DataFrame:
        used = {name: df for name, df in tables.items() if f"FROM {name}" in statement}
        for name in used:
            statement = statement.replace(f"FROM {name}", f"FROM {{{name}}}")
        return spark.sql(statement, **used)

    return {
        "spam_corpus": run(RAW_SPAM_CORPUS),
        "mailbox": run(RAW_MAILBOX),
        "general_corpus": run(RAW_GENERAL_CORPUS).withColumnsRenamed(
            {"email_text": "Email Text", "email_type": "Email Type"}
        ),
        "synthetic": run(RAW_SYNTHETIC),
    }


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four sources as one mail table."""
    raw = raw_sources(spark, sf_dir)
    return merge_sources(
        conform_spam_corpus(raw["spam_corpus"], json_trees=False),
        conform_mailbox(raw["mailbox"]),
        conform_general_corpus(raw["general_corpus"]),
        conform_synthetic(raw["synthetic"]),
    )
