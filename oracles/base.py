"""Shared CTEs over the driver tables and the helper that assembles a query."""

from __future__ import annotations

import re

CTES = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def assemble(sql: str) -> str:
    """Prefix ``sql`` with the CTEs it uses, in definition order."""
    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    if not needed:
        return sql.strip()
    parts = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in CTES if n in needed)
    return f"WITH {parts}\n{sql.strip()}"


cte("ev", """
SELECT user_id AS subject_id,
       user_id*10 + CAST(floor((dayofmonth(ts)-1)/15) AS BIGINT) AS hadm_id,
       user_id*10 + CAST(floor((dayofmonth(ts)-1)/5) AS BIGINT) AS stay_id,
       event_id, ts, event_type, value
FROM events""")
cte("icustays", """
SELECT subject_id, hadm_id, stay_id, min(ts) AS intime, max(ts) AS outtime,
       'UNIT' AS first_careunit,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS los
FROM ev GROUP BY 1, 2, 3""")
cte("admissions", """
SELECT e.subject_id, e.hadm_id, min(ts) AS admittime, max(ts) AS dischtime,
       CAST(NULL AS TIMESTAMP) AS deathtime, any_value(c_mktsegment) AS race
FROM ev e JOIN customer ON c_custkey = e.subject_id GROUP BY 1, 2""")
cte("patients", """
SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
       CAST(10 + c_custkey % 80 AS INTEGER) AS anchor_age, 2150 AS anchor_year,
       CASE c_nationkey % 6 WHEN 0 THEN '2008 - 2010' WHEN 1 THEN '2011 - 2013'
            WHEN 2 THEN '2014 - 2016' WHEN 3 THEN '2017 - 2019' WHEN 4 THEN '2020 - 2022'
            ELSE '2005 - 2007' END AS anchor_year_group,
       CAST(NULL AS DATE) AS dod
FROM customer""")
cte("diagnoses_icd", """
SELECT o_custkey AS subject_id, o_orderkey AS hadm_id,
       CASE WHEN o_totalprice > 480000
            THEN CASE WHEN o_orderstatus = 'F' THEN '5856' ELSE 'N186' END
            ELSE 'I10' END AS icd_code,
       CASE WHEN o_orderstatus = 'F' THEN 9 ELSE 10 END AS icd_version
FROM orders""")
cte("labevents", """
SELECT event_id AS labevent_id, subject_id, hadm_id,
       CASE WHEN event_type = 'purchase' THEN 50912 ELSE 50931 END AS itemid, ts AS charttime,
       CASE WHEN event_type = 'purchase' THEN value / 50.0 ELSE value END AS valuenum
FROM ev WHERE event_type IN ('purchase', 'error')""")
cte("chartevents", """
SELECT subject_id, hadm_id, stay_id, ts AS charttime, i.itemid, value AS valuenum
FROM ev JOIN (VALUES ('click', 220045, 1, 0), ('click', 224639, 7, 0), ('view', 220052, 1, 0),
                     ('view', 226531, 1, 0), ('error', 223761, 1, 0), ('error', 225792, 2, 0)
             ) AS i(kind, itemid, m, r)
  ON i.kind = ev.event_type AND ev.event_id % i.m = i.r""")
cte("inputevents", """
SELECT subject_id, hadm_id, stay_id, ts AS starttime,
       ts + to_minutes(CAST(floor(value) AS BIGINT)) AS endtime,
       CASE event_id % 4 WHEN 0 THEN 221906 WHEN 1 THEN 221794 WHEN 2 THEN 222315
            ELSE 225158 END AS itemid,
       value AS amount, CASE event_id % 3 WHEN 0 THEN 'ml' WHEN 1 THEN 'mL' ELSE 'mg' END
       AS amountuom, value AS patientweight
FROM ev WHERE event_type = 'signup'""")
cte("outputevents", """
SELECT subject_id, hadm_id, stay_id, ts AS charttime,
       CASE event_type WHEN 'view' THEN 226559 WHEN 'click' THEN 226560 ELSE 227488 END AS itemid,
       value
FROM ev WHERE event_type IN ('view', 'click', 'error')""")
cte("scored", """
SELECT l_orderkey, l_linenumber, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax,
       o_custkey AS subject_id,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity/51.0::DOUBLE AS p,
       CASE WHEN year(o_orderdate) <= 1998 THEN 'train' WHEN year(o_orderdate) = 1999 THEN 'val'
            ELSE 'test' END AS split
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
