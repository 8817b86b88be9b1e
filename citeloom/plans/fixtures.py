"""Scholarly tables derived from the given ones by SQL that Spark and DuckDB read alike.

The given tables hold no DOIs; each statement derives them row by row, over the
whole table. ``{name}`` stands for a given table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


#: A line's place on its page: line numbers repeat, so the part number follows.
LINE = 10_000_000


def d(k: str) -> str:
    """The DOI of paper number ``k``."""
    return f"concat('10.', CAST(1000 + {k} % 97 AS STRING), '/part.', CAST({k} AS STRING))"


def _s(k: str) -> str:
    return f"CAST({k} AS STRING)"


_UPPER = f"concat('10.', {_s('1000 + page_id % 97')}, '/PART.', {_s('page_id')})"
_REF = "concat('10.7777/ref.', CAST(page_id % 50 AS STRING))"

TABLES = {
    "papers": f"""SELECT p_partkey AS paper_id, {d('p_partkey')} AS doi,
        CASE WHEN p_partkey % 50 = 7 THEN replace(p_name, ' ', '') ELSE concat(p_name, ' ', lower(p_type), ' trial ', {_s('p_partkey % 500')}) END AS title,
        concat('Author', {_s('p_partkey % 40')}) AS first_author, CAST(1985 + p_size AS INT) AS year FROM {{part}}""",
    "raw_dois": f"""SELECT p_partkey AS paper_id, CASE p_partkey % 6
        WHEN 0 THEN concat('https://doi.org/', upper({d('p_partkey')})) WHEN 1 THEN concat(' DOI:', {d('p_partkey')}, ' ')
        WHEN 2 THEN replace({d('p_partkey')}, '/', '%2F') WHEN 3 THEN concat('http://dx.doi.org/', {d('p_partkey')})
        WHEN 4 THEN concat('part.', {_s('p_partkey')}) ELSE {d('p_partkey')} END AS raw FROM {{part}}""",
    "citations": """SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey AS ref_no, l_partkey AS cited,
        CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'N' THEN 'href' ELSE 'none' END AS place FROM {lineitem}""",
    "notice_events": f"""SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN replace({d('o_custkey')}, '/part.', '/PART.') ELSE {d('o_custkey')} END AS original_doi,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Retraction' WHEN '2-HIGH' THEN 'Expression of concern' WHEN '3-MEDIUM' THEN 'Reinstatement' WHEN '4-NOT SPECIFIED' THEN 'Correction' ELSE '' END AS nature,
        CAST(o_orderdate AS TIMESTAMP) AS event_time,
        CASE WHEN o_orderkey % 5 = 0 THEN 'unavailable' WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('10.9999/notice.', {_s('o_orderkey')}) END AS notice_doi FROM {{orders}}""",
    "texts": f"""SELECT doc_id, source, concat(text, ' (doi:10.', {_s('1000 + doc_id % 97')}, '/PART.', {_s('doc_id % 2000')}, '); see https://doi.org/10.5555/abc.', {_s('doc_id % 17')}, '/full.') AS text FROM {{documents}}""",
    "pages_x": f"""SELECT page_id, url, replace(replace(html, '<head>', concat('<head><meta name="citation_doi" content="', {_UPPER}, '"><meta name="citation_title" content="Page title ', {_s('page_id')}, '"><meta name="citation_author" content="Author', {_s('page_id % 40')}, '"><meta name="citation_publication_date" content="', {_s('1990 + page_id % 30')}, '/05/01">')),
        '</article>', concat('<p>As shown in 10.8888/body.', {_s('page_id % 9')}, '.</p><ol class="references" id="refs">',
        '<li>First, A. Some earlier work on the topic. 2001. doi:', {_REF}, ' Google Scholar</li>',
        '<li>Second, B. Another study of it. 2003. <a href="https://doi.org/10.6666/link.', {_s('page_id % 7')}, '">CrossRef</a></li>',
        '<li>Third, C. A report kept elsewhere. 2005. PMCID: PMC', {_s('1000 + page_id')}, '</li>',
        '<li>Fourth, D. A title without any key, 2007.</li></ol></article>')) AS html FROM {{pages}}""",
    "feedback": f"""SELECT {d('user_id')} AS doi, count(CASE WHEN event_type = 'error' THEN 1 END) AS total_comments FROM {{events}} GROUP BY user_id""",
    "evidence": f"""SELECT {d('l_partkey')} AS doi, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS replications,
        count(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber > 2 THEN 1 END) AS reproductions,
        count(CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN 1 END) AS originals FROM {{lineitem}} GROUP BY l_partkey""",
    "handles": f"""SELECT {d('p_partkey')} AS doi, CASE WHEN p_partkey % 11 = 0 THEN 404 WHEN p_partkey % 13 = 0 THEN 429 ELSE 200 END AS http_status,
        CASE WHEN p_partkey % 17 = 0 THEN 100 ELSE 1 END AS response_code FROM {{part}}""",
    "pmc_ids": f"""SELECT concat('pmc', {_s('1000 + p_partkey')}) AS pmcid, {d('p_partkey')} AS doi, CASE WHEN p_partkey % 9 = 0 THEN 'error' END AS status FROM {{part}} WHERE p_size < 40""",
    "cites": f"""SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey AS pos, {d('l_partkey')} AS doi FROM {{lineitem}}""",
    "lookups": """SELECT event_id AS request_id, user_id, CAST(ts AS TIMESTAMP) AS ts, event_type, CASE WHEN user_id % 3 = 0 THEN '/a' ELSE concat('/p', CAST(event_id % 2 AS STRING)) END AS url, user_id AS tab FROM {events}""",
    "cache": f"""SELECT {d('o_custkey')} AS key, CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE {_s('o_orderkey')} END AS value,
        CAST(o_orderdate AS TIMESTAMP) AS written_at, o_orderkey AS seq, CAST(100 + o_orderkey % 50 AS BIGINT) AS bytes, o_orderpriority = '5-LOW' AS failed FROM {{orders}}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a given one."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    given = set(re.findall(r"\{(\w+)\}", TABLES[name]))
    return spark.sql(TABLES[name], **{g: spark.read.parquet(f"{sf_dir}/{g}.parquet") for g in given})


def sql(query: str, *names: str) -> str:
    """A DuckDB query with derived tables as common table expressions."""
    parts = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', TABLES[n])})" for n in names]
    body = query.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}" if parts else body
    return f"WITH {', '.join(parts)} {body}" if parts else body
