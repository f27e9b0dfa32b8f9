"""The donor warehouse derived from a retail star schema.

Customers become constituents, orders gifts, order lines production facts and
instalments, brands funds.  Every text below is plain SQL over the retail tables
that both Spark and an ANSI engine accept; ``{orders}`` and the like stand for
the tables.  Dates move 15 years so that they fall in the default fiscal years.
The remainders only spread codes over the rows; no row is left out for speed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.stage import materialize
from .warehouse import Warehouse

RETAIL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

GIFT_DATE = "(o_orderdate + INTERVAL 15 YEAR)"
GIFT_YEAR = (
    f"CAST(year({GIFT_DATE}) + CASE WHEN month({GIFT_DATE}) >= 7 THEN 1 ELSE 0 END AS INT)"
)
DATE_ID = f"CAST(year({GIFT_DATE}) * 10000 + month({GIFT_DATE}) * 100 + day({GIFT_DATE}) AS INT)"
GIFT_TYPE_ID = (
    "CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 5 ELSE 10 END"
    " + CAST(substr(o_orderpriority, 1, 1) AS INT) AS INT)"
)
KEY_INDICATOR = "CASE WHEN {c} % 20 = 19 THEN 'O' ELSE 'I' END"
DECEASED = "CASE WHEN {c} % 17 = 0 THEN 'Yes' ELSE 'No' END"
SYSTEM_ID = "({c} * 10 + 7)"
SPOUSE = "CASE WHEN {c} % 10 < 6 THEN CASE WHEN {c} % 2 = 0 THEN {c} + 1 ELSE {c} - 1 END END"


def _money(amount: str, person: str) -> str:
    """Amounts from a few to a few thousand, by person, so every ask bracket occurs."""
    factor = (
        f"CAST(CASE {person} % 4 WHEN 0 THEN 0.0001 WHEN 1 THEN 0.0005 WHEN 2 THEN 0.0020"
        " ELSE 0.0100 END AS DECIMAL(5,4))"
    )
    return f"CAST(CAST({amount} AS DECIMAL(12,2)) * {factor} AS DECIMAL(19,4))"


GIFT_AMOUNT = _money("o_totalprice", "o_custkey")


def _fund(number: str) -> str:
    """Fund id of a brand number from 1 to 25."""
    return f"""CASE {number}
        WHEN 1 THEN '20-24400' WHEN 2 THEN '20-94430' WHEN 3 THEN '20-29300'
        WHEN 4 THEN '20-90750' WHEN 5 THEN '20-73350' WHEN 6 THEN '31-21500'
        WHEN 7 THEN '31-22500' WHEN 8 THEN '29-93300' WHEN 9 THEN '29-99970'
        WHEN 10 THEN '30-88500' WHEN 11 THEN '30-93100' WHEN 12 THEN '20-81600'
        WHEN 13 THEN '11-00100' WHEN 14 THEN '12-00200'
        ELSE 'F-' || CAST({number} AS STRING) END"""


BRAND = "CAST(substr(p_brand, 7) AS BIGINT)"


def _school_type(number: str) -> str:
    return f"""CASE {number}
        WHEN 0 THEN 'CEAT' WHEN 1 THEN 'SSB' WHEN 2 THEN 'A&S' WHEN 3 THEN 'CASNR'
        WHEN 4 THEN 'COHS' WHEN 5 THEN 'OSU-Oklahoma City'
        WHEN 6 THEN 'OSU-Institute of Technology' WHEN 7 THEN 'COE'
        WHEN 8 THEN 'Center For Health Sciences - Grad' WHEN 9 THEN 'CVHS'
        WHEN 10 THEN 'Graduate College' WHEN 11 THEN 'SIS'
        WHEN 12 THEN 'Unknown' ELSE 'Outreach' END"""


def _college(number: str) -> str:
    return f"""CASE {number}
        WHEN 0 THEN 'CEAT' WHEN 1 THEN 'Business' WHEN 2 THEN 'Arts and Sciences'
        WHEN 3 THEN 'DASNR' WHEN 4 THEN 'Human Sciences' WHEN 5 THEN 'OSU-OKC'
        WHEN 6 THEN 'OSU-Institute of Technology' WHEN 7 THEN 'College of Education'
        WHEN 8 THEN 'OSUCHS' WHEN 9 THEN 'CVHS' WHEN 10 THEN 'Graduate College'
        WHEN 11 THEN 'SIS (School of International Studies)'
        WHEN 12 THEN 'OSU-Tulsa' ELSE 'Outreach' END"""


VIEWS: dict[str, str] = {
    "constituent": f"""
        SELECT c_custkey AS constituent_dim_id,
          CASE WHEN c_custkey % 97 = 5 THEN NULL
            ELSE CAST(1000000 + c_custkey AS STRING) END AS constituent_id,
          {SYSTEM_ID.format(c="c_custkey")} AS constituent_system_id,
          CASE WHEN c_custkey % 10 < 6 THEN c_custkey - c_custkey % 2 ELSE c_custkey END * 10 + 7
            AS household_system_id,
          {SYSTEM_ID.format(c=f"({SPOUSE.format(c='c_custkey')})")} AS spouse_constituent_system_id,
          {KEY_INDICATOR.format(c="c_custkey")} AS key_indicator,
          {DECEASED.format(c="c_custkey")} AS is_deceased,
          CASE WHEN c_custkey % 23 = 0 THEN 'Yes' ELSE 'No' END AS is_inactive,
          CASE WHEN c_custkey % 31 = 0 THEN 'No' ELSE 'Yes' END AS is_a_constituent,
          CASE WHEN c_custkey % 37 = 0 THEN 'Yes' ELSE 'No' END AS no_valid_address,
          CASE WHEN c_custkey % 29 = 0 THEN 'No' ELSE 'Yes' END AS send_mail,
          CASE c_custkey % 3 WHEN 0 THEN 'Ms.' WHEN 1 THEN 'Mr.' ELSE 'Dr.' END AS title,
          substr(c_name, 1, 8) AS first_name,
          substr(c_name, 10) AS surname,
          CASE WHEN c_custkey % 4 = 0 THEN 'Nick ' || substr(c_name, 16) END AS nickname,
          CASE WHEN c_custkey % 7 = 0 THEN 'Jr.' END AS suffix,
          'Dear ' || c_name AS salutation,
          'The ' || c_name || ' Family' AS addressee,
          CASE WHEN c_custkey % 43 = 1 THEN 'Anonymous Donor #' || substr(c_name, 10)
            WHEN c_custkey % 47 = 2 THEN 'ID ' || substr(c_name, 10) || ' Unknown'
            WHEN c_custkey % 40 = 39 THEN 'Employer Unknown'
            ELSE c_name END AS full_name,
          CASE WHEN c_custkey % 53 = 3 THEN NULL
            WHEN c_custkey % 59 = 4 THEN 'Duplicate see #' || substr(c_name, 10)
            WHEN c_custkey % 61 = 5 THEN 'See Duplicate #' || substr(c_name, 10)
            WHEN c_custkey % 67 = 6 THEN '  '
            ELSE substr(c_name, 15) || ' Main Street' END AS address1,
          CASE WHEN c_custkey % 5 = 0 THEN 'Apt. ' || substr(c_name, 18) END AS address2,
          CAST(NULL AS STRING) AS address3,
          CAST(NULL AS STRING) AS address4,
          CAST(NULL AS STRING) AS address5,
          CASE WHEN c_custkey % 83 = 9 THEN '' ELSE 'City of ' || n_name END AS city,
          CASE WHEN c_custkey % 73 = 8 THEN NULL ELSE n_name END AS state,
          CASE WHEN c_custkey % 89 = 10 THEN NULL
            ELSE lpad(CAST(70000 + n_nationkey AS STRING), 5, '0') END AS post_code,
          CASE WHEN c_custkey % 71 = 7 THEN 'Elsewhere'
            WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN ''
            ELSE 'United States' END AS country,
          CASE WHEN c_custkey % 2 = 0 THEN 'c' || substr(c_name, 10) || '@example.org' END
            AS email_address
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "comprehensive_giving": f"""
        SELECT o_orderkey * 2 AS cg_fact_id, o_orderkey AS gift_fact_id,
          o_custkey AS constituent_dim_id, {GIFT_AMOUNT} AS amount,
          {_fund("(o_orderkey % 25 + 1)")} AS fund, {GIFT_YEAR} AS gift_fiscal_year,
          'Gift' AS gift_type, {GIFT_DATE} AS gift_date
        FROM {{orders}}
        UNION ALL
        SELECT o_orderkey * 2 + 1 AS cg_fact_id, o_orderkey AS gift_fact_id,
          {SPOUSE.format(c="o_custkey")} AS constituent_dim_id, {GIFT_AMOUNT} AS amount,
          {_fund("(o_orderkey % 25 + 1)")} AS fund, {GIFT_YEAR} AS gift_fiscal_year,
          'Soft Credit' AS gift_type, {GIFT_DATE} AS gift_date
        FROM {{orders}}
        WHERE {SPOUSE.format(c="o_custkey")} IS NOT NULL AND o_orderstatus <> 'P'""",
    "gift_credit": f"""
        SELECT o_orderkey AS gift_fact_id,
          CASE WHEN o_orderkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS is_ag_gift,
          CASE WHEN o_orderkey % 5 > 0 THEN 'AP' || CAST(o_orderkey % 30 AS STRING) END
            AS appeal_identifier
        FROM {{orders}}""",
    "gift": f"""
        SELECT o_orderkey AS gift_fact_id, o_orderkey * 3 + 1 AS gift_system_id,
          {GIFT_TYPE_ID} AS gift_type_dim_id, {DATE_ID} AS gift_date_dim_id,
          o_orderkey % 25 + 1 AS fund_dim_id, o_orderkey % 30 AS appeal_dim_id,
          o_custkey AS constituent_dim_id,
          CASE WHEN o_orderkey % 22 = 0 THEN -5
            WHEN o_orderkey % 11 = 0 THEN (o_orderkey - 11) * 3 + 1 END AS planned_gift_id,
          CASE WHEN o_orderkey % 33 = 0 THEN {GIFT_DATE} - INTERVAL 30 YEAR  -- before the calendar
            ELSE {GIFT_DATE} END AS gift_date,
          {GIFT_AMOUNT} AS amount
        FROM {{orders}}""",
    "gift_type": f"""
        SELECT gift_type_dim_id,
          CASE gift_type_dim_id WHEN 1 THEN 'Pledge' WHEN 2 THEN 'Pay-Cash'
            WHEN 3 THEN 'Cash' WHEN 4 THEN 'MG Pledge' WHEN 5 THEN 'MG Pay-Cash'
            WHEN 6 THEN 'Recurring Gift' WHEN 7 THEN 'Recurring Gift Pay-Cash'
            WHEN 8 THEN 'Pay-Check' WHEN 9 THEN 'Planned Gift' WHEN 10 THEN 'Cash'
            WHEN 11 THEN 'Pay-Cash' WHEN 12 THEN 'Stock' WHEN 13 THEN 'Planned Gift'
            WHEN 14 THEN 'Other' ELSE 'Pay-Stock' END AS gift_type
        FROM (SELECT DISTINCT {GIFT_TYPE_ID} AS gift_type_dim_id FROM {{orders}}) AS t""",
    "gift_attribute": """
        SELECT l_orderkey AS gift_fact_id,
          CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'Planned Gift Realized'
            ELSE 'Acknowledgement' END AS attribute_category
        FROM {lineitem}""",
    "gift_commitment": f"""
        SELECT o_orderkey AS gift_fact_id,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {GIFT_AMOUNT} END AS amount,
          CASE o_orderkey % 3 WHEN 0 THEN NULL
            WHEN 1 THEN CAST(1.5 AS DECIMAL(19,4)) ELSE {GIFT_AMOUNT} END AS write_off_amount
        FROM {{orders}}
        WHERE o_orderstatus <> 'P'""",
    "installment_payment": f"""
        SELECT l_orderkey AS gift_payment_fact_id,
          c.commitment * 3 + 1 AS gift_commitment_system_id
        FROM {{lineitem}}
        JOIN {{orders}} ON l_orderkey = o_orderkey
        JOIN (
          SELECT o_custkey AS payer, {GIFT_YEAR} AS pledge_year, min(o_orderkey) AS commitment
          FROM {{orders}} GROUP BY o_custkey, {GIFT_YEAR}
        ) AS c ON o_custkey = c.payer AND {GIFT_YEAR} - l_linenumber % 2 = c.pledge_year
        WHERE l_orderkey <> c.commitment""",
    "recurring_gift": f"""
        SELECT o_orderkey AS gift_fact_id, {GIFT_AMOUNT} AS amount,
          CASE WHEN o_orderkey % 2 = 0 THEN CAST(2.25 AS DECIMAL(19,4)) END AS write_offs
        FROM {{orders}}
        WHERE o_orderstatus = 'O'""",
    "calendar": f"""
        SELECT DISTINCT {DATE_ID} AS date_dim_id, CAST({GIFT_DATE} AS DATE) AS actual_date,
          {GIFT_YEAR} AS fiscal_year
        FROM {{orders}}
        UNION ALL
        SELECT CAST(19000101 AS INT) AS date_dim_id, CAST('1900-01-01' AS DATE) AS actual_date,
          CAST(1900 AS INT) AS fiscal_year
        FROM {{region}} WHERE r_regionkey = 0""",
    "annual_projection": f"""
        SELECT o_orderkey AS cap_dim_id, CAST(1000000 + o_custkey AS STRING) AS constituent_id,
          CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END AS gift_fact_id,
          CASE WHEN o_orderkey % 13 = 0 THEN CAST(0 AS DECIMAL(19,4)) ELSE {GIFT_AMOUNT} END
            AS gift_amount,
          {_fund("(o_orderkey % 25 + 1)")} AS fund_identifier,
          CAST(2015 + o_orderkey % 3 AS INT) AS fiscal_year,
          {GIFT_DATE} AS gift_date, {GIFT_DATE} AS gift_commitment_date,
          CASE WHEN o_orderkey % 4 = 0 THEN 'No' ELSE 'Yes' END AS is_ag_gift,
          CASE WHEN o_orderkey % 6 > 0 THEN 'AP' || CAST(o_orderkey % 30 AS STRING) END
            AS appeal_identifier
        FROM {{orders}}
        WHERE o_orderstatus = 'P'""",
    "production": f"""
        SELECT l_orderkey * 10000000000 + l_partkey * 10 + l_linenumber AS ocpr_dim_id,
          o_custkey AS constituent_dim_id, l_orderkey AS gift_fact_id,
          CASE WHEN l_returnflag = 'A' AND l_suppkey % 2 = 0 THEN 'MG Pledge'
            WHEN l_returnflag = 'R' THEN 'Other' ELSE 'Cash' END AS gift_type,
          CASE WHEN l_linenumber >= 5 THEN 'Recognition Credit' ELSE 'Regular' END
            AS gift_sub_type,
          CASE WHEN l_partkey % 2 = 0 THEN 'Corporate MatchingGift' ELSE 'Gift' END
            AS cg_gift_type,
          {_fund(BRAND)} AS fund_identifier,
          CASE WHEN l_discount = 0 THEN CAST(0 AS DECIMAL(19,4))
            ELSE {_money("l_extendedprice", "o_custkey")} END AS cgpr_amount,
          {GIFT_DATE} AS gift_date, {GIFT_YEAR} AS fiscal_year,
          CASE WHEN p_size <= 25 THEN 'Yes' ELSE 'No' END AS is_ag_gift,
          CASE WHEN l_linenumber <= 4 THEN 'Development'
            WHEN l_linenumber = 5 THEN 'OSUAA Membership Dues'
            WHEN l_linenumber = 6 THEN 'Recognition Credit' ELSE 'Outside' END AS data_source,
          CASE WHEN l_linestatus = 'F' THEN 'Production' ELSE 'Receipts' END AS measure,
          {KEY_INDICATOR.format(c="o_custkey")} AS key_indicator,
          {DECEASED.format(c="o_custkey")} AS is_deceased
        FROM {{lineitem}}
        JOIN {{orders}} ON l_orderkey = o_orderkey
        JOIN {{part}} ON l_partkey = p_partkey""",
    "primary_code": """
        SELECT c_custkey AS constituent_dim_id,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Alumni' WHEN 'BUILDING' THEN 'Attended'
            WHEN 'FURNITURE' THEN 'Friend' WHEN 'HOUSEHOLD' THEN 'Alumni'
            ELSE CASE c_custkey % 4 WHEN 0 THEN 'Student' WHEN 1 THEN 'Contact'
              WHEN 2 THEN 'Corporation' ELSE 'Friend' END END AS constituent_code
        FROM {customer}""",
    "position": """
        SELECT user_id AS constituent_dim_id,
          CASE WHEN event_type = 'error' AND value > 100 THEN 'Board of Governor-Current'
            WHEN event_type = 'click' AND value > 150 THEN 'Principal Gift Prospect'
            ELSE 'Volunteer' END AS position
        FROM {events}""",
    "constituent_code": """
        SELECT c_custkey AS constituent_dim_id,
          CASE c_custkey % 19 WHEN 3 THEN 'Faculty/Staff' WHEN 5 THEN 'CVHS Client'
            WHEN 7 THEN 'OSUAA Legacy - Former' WHEN 8 THEN 'Faculty/Staff - Former'
            WHEN 9 THEN 'Utility Record' ELSE 'Alumni' END AS constituent_code
        FROM {customer}
        UNION ALL
        SELECT user_id AS constituent_dim_id,
          CASE WHEN event_type = 'signup' AND value > 200 THEN 'On Hold New Record'
            WHEN event_type = 'view' THEN 'CVHS Client' ELSE 'Parent' END AS constituent_code
        FROM {events}""",
    "financial_information": """
        SELECT c_custkey AS constituent_dim_id,
          'Lifetime Comprehensive Giving' AS information_type,
          CASE WHEN c_custkey % 6 = 0 THEN 'Other Foundation' ELSE 'OSU Foundation' END
            AS information_source,
          CASE WHEN c_custkey % 5 = 0 THEN CAST(0 AS DECIMAL(19,4))
            ELSE CAST(c_acctbal AS DECIMAL(19,4)) END AS value
        FROM {customer}""",
    "constituent_attribute": """
        SELECT user_id AS constituent_dim_id, 'Solicit Code' AS attribute_category,
          CASE WHEN event_type = 'error' AND value > 120 THEN 'X3 - No Contact'
            WHEN event_type = 'purchase' AND value > 180 THEN 'SF - No Solicitation'
            ELSE 'PN - Prefers Newsletter' END AS attribute_description,
          CAST(NULL AS STRING) AS comments
        FROM {events}
        UNION ALL
        SELECT c_custkey AS constituent_dim_id, 'Loyalty Giving' AS attribute_category,
          CAST(c_custkey % 40 AS STRING) AS attribute_description,
          CASE WHEN c_custkey % 3 = 0 THEN 'Alumni Association' ELSE 'OSU Foundation' END
            AS comments
        FROM {customer}""",
    "us_state": "SELECT n_name AS state FROM {nation} WHERE n_nationkey <> 13",
    "education": f"""
        SELECT c_custkey AS constituent_dim_id, c_custkey * 2 AS constituent_education_dim_id,
          CASE c_custkey % 8 WHEN 5 THEN 'OSU-Oklahoma City'
            WHEN 6 THEN 'OSU-Center for Health Sciences'
            WHEN 7 THEN 'OSU-Institute of Technology' WHEN 4 THEN 'Another University'
            ELSE 'Oklahoma State University' END AS school_name,
          {_school_type("c_nationkey % 14")} AS school_type,
          CASE c_custkey % 5 WHEN 0 THEN 'Doctor of Philosophy' WHEN 1 THEN 'Master of Science'
            WHEN 2 THEN NULL ELSE 'Bachelor of Arts' END AS degree,
          'Yes' AS is_primary,
          CASE c_custkey % 6 WHEN 0 THEN '1999' WHEN 1 THEN '200205' WHEN 2 THEN '19870512'
            WHEN 3 THEN '' WHEN 4 THEN '199913' END AS fuzzy_date_graduated,
          CASE WHEN c_custkey % 9 > 0 THEN CAST(1950 + c_custkey % 60 AS INT) END AS class_year
        FROM {{customer}}
        UNION ALL
        SELECT c_custkey AS constituent_dim_id, c_custkey * 2 + 1 AS constituent_education_dim_id,
          'Oklahoma State University' AS school_name,
          {_school_type("c_custkey % 14")} AS school_type,
          CASE WHEN c_custkey % 4 = 0 THEN 'Master of Arts' ELSE 'Certificate' END AS degree,
          CASE WHEN c_custkey % 11 = 0 THEN 'Yes' ELSE 'No' END AS is_primary,
          CAST(NULL AS STRING) AS fuzzy_date_graduated, CAST(NULL AS INT) AS class_year
        FROM {{customer}}""",
    "education_major": """
        SELECT o_custkey AS constituent_dim_id,
          o_custkey * 2 + o_orderkey % 2 AS constituent_education_dim_id,
          o_orderpriority AS major_code, CAST(o_orderkey % 3 AS INT) AS sequence
        FROM {orders}""",
    "education_attribute": """
        SELECT o_custkey AS constituent_dim_id,
          o_custkey * 2 + o_orderkey % 2 AS constituent_education_dim_id,
          CASE WHEN o_orderkey % 100 = 3 THEN 'Degree Honors Degree'
            WHEN o_orderkey % 50 = 7 THEN 'Degree OSU-Tulsa Commencement Participant'
            ELSE 'Degree Department' END AS attribute_category,
          CASE WHEN o_orderkey % 100 = 3 OR o_orderkey % 50 = 7
            THEN CASE WHEN o_orderstatus = 'P' THEN 'No' ELSE 'Yes' END
            ELSE 'Department ' || CAST(o_orderkey % 6 AS STRING) END AS attribute_description,
          CAST(o_orderkey % 4 AS INT) AS sequence
        FROM {orders}""",
    "address": """
        SELECT c_custkey AS constituent_dim_id, c_custkey * 3 AS constituent_address_system_id,
          'Home' AS address_type,
          CASE WHEN c_custkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS preferred
        FROM {customer}
        UNION ALL
        SELECT c_custkey AS constituent_dim_id, c_custkey * 3 + 1 AS constituent_address_system_id,
          CASE WHEN c_custkey % 2 = 0 THEN 'Home' ELSE 'Business' END AS address_type,
          CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS preferred
        FROM {customer}""",
    "phone": """
        SELECT o_custkey AS constituent_dim_id,
          o_custkey * 3 + o_orderkey % 2 AS constituent_address_system_id,
          CASE o_orderkey % 14 WHEN 0 THEN 'Home' WHEN 1 THEN 'Phone' WHEN 2 THEN 'Home 2'
            WHEN 3 THEN 'Home 4' WHEN 4 THEN 'Home Cell' WHEN 5 THEN 'Home Cell 2'
            WHEN 6 THEN 'PhoneFinder' WHEN 7 THEN 'PhoneFinder13' WHEN 8 THEN 'Home Fax'
            WHEN 9 THEN 'Home Email' WHEN 10 THEN 'Local Phone' WHEN 11 THEN 'AlumniSync Cell'
            WHEN 12 THEN 'Home Cell Foreign' ELSE 'Home Pager' END AS phone_type,
          CASE o_orderkey % 9 WHEN 0 THEN 'donor@example.org' WHEN 1 THEN '555-12'
            WHEN 2 THEN '(000) 0000-0000000'
            ELSE '(' || lpad(CAST(o_orderkey % 800 + 200 AS STRING), 3, '0') || ') '
              || lpad(CAST(o_orderkey % 900 + 100 AS STRING), 3, '0') || '-'
              || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') END AS phone_number
        FROM {orders}""",
    "donor_type": f"""
        SELECT {SYSTEM_ID.format(c="c_custkey")} AS constituent_system_id,
          CASE c_custkey % 5 WHEN 0 THEN '4+ Year Lapsed' WHEN 1 THEN '2-3 Year Lapsed'
            WHEN 2 THEN 'Current Year' WHEN 3 THEN 'Last Year' ELSE 'Never Gave' END
            AS dpag_donor_type_bucket,
          CAST(2017 AS INT) AS fiscal_year
        FROM {{customer}} WHERE c_mktsegment <> 'MACHINERY'
        UNION ALL
        SELECT {SYSTEM_ID.format(c="c_custkey")} AS constituent_system_id,
          'Last Year' AS dpag_donor_type_bucket, CAST(2016 AS INT) AS fiscal_year
        FROM {{customer}}""",
    "fund": f"""
        SELECT fund_dim_id, {_fund("fund_dim_id")} AS fund_identifier,
          'Fund of ' || brand AS fund_description,
          CASE WHEN fund_dim_id % 9 = 0 THEN 'Yes' ELSE 'No' END AS is_inactive
        FROM (SELECT DISTINCT {BRAND} AS fund_dim_id, p_brand AS brand FROM {{part}}) AS b""",
    "solicitable_fund": f"""
        SELECT {_fund("number")} AS designation
        FROM (SELECT {BRAND} AS number FROM {{part}}) AS b
        WHERE number % 2 = 0""",
    "appeal": """
        SELECT CAST(n_nationkey AS BIGINT) AS appeal_dim_id,
          'AP' || CAST(n_nationkey AS STRING) AS appeal_identifier,
          CASE WHEN n_regionkey = 0 THEN 'ANNGIVING' ELSE 'AG2016' END AS campaign_identifier
        FROM {nation}""",
    "fund_translation": f"""
        SELECT DISTINCT {_fund("number")} AS fund_identifier,
          {_fund("(CASE WHEN number % 5 = 0 THEN number + 2 ELSE number + 1 END)")}
            AS suggested_fund_identifier
        FROM (SELECT {BRAND} AS number FROM {{part}}) AS b
        WHERE number % 2 = 1 AND number % 3 <> 0
        UNION ALL
        SELECT DISTINCT {_fund("number")} AS fund_identifier, 'F-24' AS suggested_fund_identifier
        FROM (SELECT {BRAND} AS number FROM {{part}}) AS b
        WHERE number IN (7, 19)""",
    "department_fund": f"""
        SELECT college, degree_department, degree_major_description,
          {_fund("(low % 25 + 1)")} AS fund_id1, {_fund("(high % 25 + 1)")} AS fund_id2
        FROM (
          SELECT {_college("s_nationkey % 14")} AS college,
            CASE WHEN s_suppkey % 7 = 6 THEN CASE WHEN s_suppkey % 2 = 0 THEN '' END
              ELSE 'Department ' || CAST(s_suppkey % 7 AS STRING) END AS degree_department,
            CASE WHEN s_suppkey % 5 = 4 THEN 'History' WHEN s_suppkey % 5 = 3 THEN '' END
              AS degree_major_description,
            min(s_suppkey) AS low, max(s_suppkey) AS high
          FROM {{supplier}}
          GROUP BY 1, 2, 3
        ) AS s""",
    "manager": """
        SELECT c_custkey AS constituent_dim_id,
          CASE WHEN c_custkey % 6 = 0 THEN 'Manager ' || CAST(c_custkey % 12 AS STRING) END AS mgr1,
          CASE WHEN c_custkey % 12 = 0 THEN 'Manager B' END AS mgr2,
          CASE WHEN c_custkey % 24 = 0 THEN 'Manager C' END AS mgr3,
          CASE WHEN c_custkey % 5 = 0 THEN 'College Liaison' END AS cl1,
          CASE WHEN c_custkey % 10 = 0 THEN 'Second Liaison' END AS cl2,
          CASE WHEN c_custkey % 20 = 0 THEN 'Third Liaison' END AS cl3,
          CASE WHEN c_custkey % 4 = 0 THEN 'Discovery Manager' END AS disc_mgr,
          CASE WHEN c_custkey % 3 = 0 THEN 'Discovery Liaison' END AS disc_cl_mgr
        FROM {customer} WHERE c_acctbal > 0""",
    "relationship": """
        SELECT c_custkey AS constituent_dim_id,
          c_custkey - c_custkey % 20 + 19 AS related_constituent_dim_id,
          CASE WHEN c_custkey % 7 = 0 THEN 'Friend' ELSE 'Employer' END AS relationship,
          CASE WHEN c_custkey % 7 = 0 THEN 'Friend' ELSE 'Employee' END AS reciprocal,
          CASE WHEN c_custkey % 4 > 0 THEN 'Grade ' || CAST(c_custkey % 9 AS STRING) END
            AS position,
          CASE WHEN c_custkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS is_primary
        FROM {customer} WHERE c_custkey % 20 <> 19
        UNION ALL
        SELECT o_custkey AS constituent_dim_id, 19 + (o_orderkey % 5) * 20
            AS related_constituent_dim_id,
          'Employer' AS relationship, 'Employee' AS reciprocal, 'Consultant' AS position,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'No' END AS is_primary
        FROM {orders} WHERE o_orderstatus = 'P'""",
    "fund_attribute": f"""
        SELECT DISTINCT {BRAND} AS fund_dim_id, 'College' AS attribute_category,
          {_college(f"{BRAND} % 14")} AS attribute_description
        FROM {{part}}
        UNION ALL
        SELECT DISTINCT {BRAND} AS fund_dim_id, 'Department' AS attribute_category,
          'Department ' || CAST({BRAND} % 6 AS STRING) AS attribute_description
        FROM {{part}} WHERE {BRAND} % 4 > 0""",
}


# The rows of the views of the same names, joined in an order that moves less: an order finds its
# commitments before its lines come, and lines meet their parts before their orders, so that they
# end up where their gift is.  A remainder is -1, 0 or 1: the year itself and the two beside it.
ARRANGED = {
    "installment_payment": f"""
        SELECT l_orderkey AS gift_payment_fact_id, commitment * 3 + 1 AS gift_commitment_system_id
        FROM (
          SELECT l_orderkey, CASE back WHEN 0 THEN same WHEN 1 THEN before WHEN -1 THEN after END AS commitment
          FROM (SELECT l_orderkey, CAST(l_linenumber % 2 AS TINYINT) AS back FROM {{lineitem}})
          JOIN (
            SELECT o_orderkey, same, before, after
            FROM {{orders}} JOIN (
              SELECT payer, pledge_year, commitment AS same,
                min(commitment) OVER (
                  PARTITION BY payer ORDER BY pledge_year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS before,
                min(commitment) OVER (
                  PARTITION BY payer ORDER BY pledge_year RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS after
              FROM (
                SELECT o_custkey AS payer, {GIFT_YEAR} AS pledge_year, min(o_orderkey) AS commitment
                FROM {{orders}} GROUP BY o_custkey, {GIFT_YEAR}
              )
            ) AS c ON o_custkey = payer AND {GIFT_YEAR} = pledge_year
          ) AS o ON l_orderkey = o_orderkey
        ) WHERE l_orderkey <> commitment""",
    "production": VIEWS["production"].replace(
        """
        JOIN {orders} ON l_orderkey = o_orderkey
        JOIN {part} ON l_partkey = p_partkey""",
        """
        JOIN {part} ON l_partkey = p_partkey
        JOIN {orders} ON l_orderkey = o_orderkey""",
    ),
}


def tables_in(text: str) -> list[str]:
    """Retail tables a view reads."""
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


# Small dimensions that the views gather from facts.  As tables they have their true size, and a
# fact that asks them for a code does not gather them anew.
DIMENSIONS = (
    "gift_type", "calendar", "fund", "solicitable_fund", "fund_translation", "fund_attribute", "department_fund",
)


def retail_warehouse(spark: SparkSession, folder: str, dimensions: str = "lazy") -> Warehouse:
    """Warehouse over the retail parquet files in ``folder``.

    ``dimensions`` says how the small tables are kept (:func:`patronage.operators.stage.materialize`).
    """
    files: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in files:
            files[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        return files[name]

    def open_view(name: str) -> DataFrame:
        text = ARRANGED.get(name, VIEWS[name])
        view = spark.sql(text, **{t: table(t) for t in tables_in(text)})
        return materialize(view, name, dimensions) if name in DIMENSIONS else view

    return Warehouse(open_view)
