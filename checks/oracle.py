"""SQL that computes every registered query independently of the Spark code.

Each stage is written row by row as the rules read (one join per fact, window
ranks, one turn per fiscal year) and not as the operators do it.  ``STAGES``
holds the building blocks, ``FINAL`` the query of each name; ``oracle(name)``
puts the blocks a query needs into one WITH clause.
"""

from __future__ import annotations

import re

from patronage.sources.retail import RETAIL_TABLES, VIEWS

P = "constituent_dim_id"
ACTIVE = "{c}.key_indicator = 'I' AND {c}.is_deceased = 'No' AND {c}.is_inactive = 'No'"
ANNUAL = (
    "is_ag_gift = 'Yes' AND cgpr_amount > 0 AND data_source IN "
    "('Development', 'OSUAA Membership Dues', 'Recognition Credit')"
)


def _projected(year: int, before: str) -> str:
    return f"""
        SELECT -p.cap_dim_id AS cg_fact_id, -p.cap_dim_id AS gift_fact_id, c.{P},
          p.gift_amount AS amount, p.fund_identifier AS fund, p.fiscal_year AS gift_fiscal_year,
          'Annual Projection' AS gift_type, p.gift_date, p.is_ag_gift, p.appeal_identifier,
          'Annual Projection' AS re_gift_type
        FROM w_annual_projection p JOIN w_constituent c ON p.constituent_id = c.constituent_id
        WHERE p.gift_amount > 0 AND p.gift_commitment_date < TIMESTAMP '{before}'
          AND p.gift_fact_id IS NULL AND p.fiscal_year = {year}
          AND c.is_deceased = 'No' AND c.is_inactive = 'No'"""


def _status(grace: bool) -> str:
    def clash(year: str, what: str) -> str:
        late = f"""
            WHEN gift_fiscal_year - 1 = {year} AND gift_date >= make_timestamp(fy, 7, 1, 0, 0, 0)
              AND gift_date <= make_timestamp(fy, 7, 21, 0, 0, 0)
              THEN 'Exclude - {what.replace("Realized", "Realize")} made in the following fiscal but up to 7/21'"""
        return f"""CASE WHEN gift_fiscal_year = {year} THEN 'Exclude - {what} made in the same year as {"Planned Gift" if "Planned" in what else "the pledge"}'
            {late if grace else ""} ELSE 'Include' END"""

    return f"""CASE
        WHEN re_gift_type = 'Planned Gift' THEN 'Include'
        WHEN planned_gift_fiscal_year IS NOT NULL
          THEN {clash("planned_gift_fiscal_year", "Realized Planned Gift")}
        WHEN re_gift_type LIKE 'Pay-%' AND fund NOT IN ('11-00100', '12-00200') AND is_credited
          THEN {clash("pledge_fiscal_year", "Pledge Payment")}
        WHEN re_gift_type = 'Recurring Gift Pay-Cash' AND is_credited
          THEN {clash("pledge_fiscal_year", "Recurring Gift Payment")}
        WHEN re_gift_type LIKE 'MG Pay%' THEN {clash("pledge_fiscal_year", "Matching Gift Payment")}
        ELSE 'Include' END"""


def _first_per_payment(source: str) -> str:
    return f"""
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY {P}, cg_fact_id, fy
            ORDER BY countable DESC, commitment_gift_fact_id ASC NULLS LAST) AS seq
          FROM {source}) q
        WHERE seq = 1"""


def _totals(*sources: str) -> str:
    union = " UNION ALL ".join(
        f"SELECT {P}, fy, countable FROM {s} WHERE status = 'Include' AND countable > 0"
        for s in sources
    )
    return f"""
        SELECT q.{P}, CAST(q.fy AS INT) AS fiscal_year, CAST(sum(q.countable) AS DECIMAL(19,4)) AS amount
        FROM ({union}) q JOIN w_constituent c ON q.{P} = c.{P}
        WHERE {ACTIVE.format(c="c")}
        GROUP BY q.{P}, q.fy HAVING sum(q.countable) > 0"""


def _fund_rank(measure: str, name: str) -> str:
    return f"""
        SELECT q.{P}, q.fund_identifier_trans, q.{name},
          row_number() OVER (PARTITION BY q.{P} ORDER BY q.{name} DESC, q.fund_identifier_trans) AS seq
        FROM (SELECT {P}, fund_identifier_trans, {measure} AS {name} FROM s_production_gifts
              WHERE is_matching_gift = 'No' GROUP BY {P}, fund_identifier_trans) q
        JOIN w_fund f ON q.fund_identifier_trans = f.fund_identifier"""


def _expanded(source: str) -> str:
    return f"""
        SELECT {P} FROM {source}
        UNION
        SELECT s.{P} FROM {source} m JOIN w_constituent c ON m.{P} = c.{P}
          JOIN w_constituent s ON c.spouse_constituent_system_id = s.constituent_system_id
        WHERE s.constituent_id IS NOT NULL"""


def _phone(name: str, steps: list[tuple[str, int]], prefixes: list[str]) -> str:
    ladder = " ".join(
        f"WHEN phone_type = '{t}' AND preferred = 'Yes' THEN {2 * i}"
        f" WHEN phone_type = '{t}' THEN {2 * i + 1}"
        for t, i in steps
    )
    starts = " OR ".join(f"phone_type ILIKE '{p}%'" for p in prefixes)
    return f"""
        SELECT {P}, phone_number, phone_type FROM (
          SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY step, phone_number, phone_type) AS seq
          FROM (SELECT a.{P}, p.phone_number, p.phone_type, CASE {ladder} END AS step
                FROM w_address a JOIN s_clean_phone p ON a.{P} = p.{P}
                  AND a.constituent_address_system_id = p.constituent_address_system_id
                WHERE a.address_type = 'Home' AND ({starts})) q
          WHERE step IS NOT NULL) r
        WHERE seq = 1"""


HOME_STEPS = [(t, i) for i, t in enumerate(["Home", "Phone", "Home 2", "Home 3", "Home 4"])]
HOME_STEPS += [("PhoneFinder", 10)] + [(f"PhoneFinder{n}", 10 + n) for n in range(2, 21)]
CELL_STEPS = [
    (t, i) for i, t in enumerate(["Home Cell", "Home Cell 2", "Home Cell 3", "Home Cell 4"])
]

ACTIVE_PERSON = (
    "c.constituent_id IS NOT NULL AND c.key_indicator = 'I' AND c.is_inactive = 'No'"
)


def _arm(order: int, fund: str, label: str, people: str, spouse: bool = False) -> str:
    """One arm of the cascade: people (column ``id``) times one fund."""
    if spouse:
        people = f"""SELECT s.{P} AS id FROM ({people}) g JOIN w_constituent c ON g.id = c.{P}
            JOIN w_constituent s ON c.spouse_constituent_system_id = s.constituent_system_id
            WHERE s.constituent_id IS NOT NULL"""
    return f"""SELECT q.id AS {P}, f.fund_identifier, f.fund_description,
        {order} AS designations_order, '{label}' AS data_source
        FROM ({people}) q JOIN w_fund f ON f.fund_identifier = '{fund}'"""


def _cascade() -> str:
    everyone = f"SELECT c.{P} AS id FROM w_constituent c WHERE {ACTIVE_PERSON}"
    graduate = f"""SELECT DISTINCT {P} AS id FROM w_education
        WHERE school_name = 'Oklahoma State University'
          AND (degree ILIKE '%doc%' OR degree ILIKE '%mast%')"""
    honors = f"""SELECT DISTINCT {P} AS id FROM w_education_attribute
        WHERE attribute_category = 'Degree Honors Degree' AND attribute_description = 'Yes'"""

    def school(name: str) -> str:
        return f"""SELECT c.{P} AS id FROM w_constituent c JOIN s_education e ON c.{P} = e.{P}
            WHERE {ACTIVE_PERSON} AND e.school_name = '{name}'"""

    main, city = "Oklahoma State University", "OSU-Oklahoma City"
    health, technology = "OSU-Center for Health Sciences", "OSU-Institute of Technology"
    arms = [
        _arm(o, f, "Specified Fund", everyone)
        for o, f in ((108, "20-24400"), (119, "20-24400"), (120, "20-81600"), (121, "20-19650"))
    ]
    pairs = [
        (109, "20-94430", "Grad College", graduate),
        (110, "20-29300", "Honors College", honors),
        (111, "20-90750", "Specified Fund", school(main)),
        (112, "20-73350", "Specified Fund", school(main)),
        (113, "31-21500", "Specified Fund", school(health)),
        (114, "31-22500", "Specified Fund", school(health)),
        (115, "29-93300", "Specified Fund", school(technology)),
        (116, "29-99970", "Specified Fund", school(technology)),
        (117, "30-88500", "Specified Fund", school(city)),
        (118, "30-93100", "Specified Fund", school(city)),
    ]
    for order, fund, label, people in pairs:
        arms += [_arm(order, fund, label, people), _arm(order, fund, label, people, True)]
    for level, blanks, first, match, own, other in (
        (
            "Dept",
            "Blank Majors column",
            100,
            "e.school_type_trans = d.college AND e.department = d.degree_department",
            "coalesce(rtrim(d.degree_department), '') <> ''"
            " AND coalesce(rtrim(d.degree_major_description), '') = ''",
            "coalesce(rtrim(d.degree_department), '') <> ''",
        ),
        (
            "College",
            "Blank Majors column, Blank Dept Column",
            104,
            "e.school_type_trans = d.college",
            *[
                "coalesce(rtrim(d.degree_department), '') = ''"
                " AND coalesce(rtrim(d.degree_major_description), '') = ''"
            ]
            * 2,
        ),
    ):
        for n in (1, 2):
            order = first + 2 * (n - 1)
            arms.append(f"""SELECT e.{P}, f.fund_identifier, f.fund_description,
                {order} AS designations_order, 'Const Pri Degree {level} Fund{n} ({blanks})' AS data_source
                FROM s_education e JOIN w_department_fund d ON {match}
                JOIN w_fund f ON d.fund_id{n} = f.fund_identifier WHERE {own}""")
            arms.append(f"""SELECT s.{P}, f.fund_identifier, f.fund_description,
                {order + 1} AS designations_order,
                'Spouse {"Const " if level == "Dept" else ""}Pri Degree {level} Fund{n} ({blanks})' AS data_source
                FROM s_education e JOIN w_department_fund d ON {match}
                JOIN w_fund f ON d.fund_id{n} = f.fund_identifier
                JOIN w_constituent c ON e.{P} = c.{P}
                JOIN w_constituent s ON c.spouse_constituent_system_id = s.constituent_system_id
                WHERE {other} AND s.constituent_id IS NOT NULL""")
    return " UNION ALL ".join(arms)


def _sequenced(source: str, first: int, last: int) -> str:
    return f"""
        SELECT {P}, fund_identifier, fund_description,
          CAST(row_number() OVER (PARTITION BY {P} ORDER BY min(seq)) AS INT) AS seq
        FROM (SELECT *, row_number() OVER (PARTITION BY {P}
                ORDER BY designations_order, fund_identifier, fund_description, data_source) AS seq
              FROM {source}) q
        WHERE {P} IN (SELECT {P} FROM s_giving WHERE fiscal_year BETWEEN {first} AND {last})
        GROUP BY {P}, fund_identifier, fund_description"""


def _ask(i: int) -> str:
    flat = ("100", "50", "25")[i]
    times = (("2", "1.5", "1.1"), ("1.1", "1.1", "1"), ("0.5", "0.5", "0.5"))[i]
    several = "marketing_segment = '2YRG2-3LAPSED'"
    return f"""CAST(CASE
        WHEN marketing_segment IN ('4PLUS', '1YRG2-3LAPSED') THEN {flat}
        WHEN {several} AND avg_amount <= 75 THEN {flat}
        WHEN {several} AND avg_amount BETWEEN 75 AND 250 THEN avg_amount * {times[0]}
        WHEN {several} AND avg_amount BETWEEN 250 AND 1000 THEN avg_amount * {times[1]}
        WHEN {several} AND avg_amount >= 1000 THEN avg_amount * {times[2]}
        END AS DECIMAL(24,6)) AS ask_{i + 1}"""


def _snap(i: int) -> str:
    low, middle, high = ((200, 1000, 5000), (100, 500, 2500), (50, 200, 1000))[i]
    several, raw = "marketing_segment = '2YRG2-3LAPSED'", f"ask_{i + 1}"
    return f"""CASE
        WHEN {several} AND {raw} > 75 AND {raw} < 250 THEN {low}
        WHEN {several} AND {raw} > 250 AND {raw} < 1000 THEN {middle}
        WHEN {several} AND {raw} > 1000 THEN {high}
        ELSE round(CAST({raw} AS DOUBLE) / 5) * 5 END"""


STAGES: dict[str, str] = {
    "s_ledger": f"""
        SELECT cg.cg_fact_id, cg.gift_fact_id, cg.{P}, cg.amount, cg.fund, cg.gift_fiscal_year,
          cg.gift_type, cg.gift_date, og.is_ag_gift, og.appeal_identifier,
          gt.gift_type AS re_gift_type
        FROM w_comprehensive_giving cg
        JOIN w_constituent c ON cg.{P} = c.{P}
        JOIN w_gift_credit og ON cg.gift_fact_id = og.gift_fact_id
        JOIN w_gift g ON cg.gift_fact_id = g.gift_fact_id
        JOIN w_gift_type gt ON g.gift_type_dim_id = gt.gift_type_dim_id
        WHERE {ACTIVE.format(c="c")}""",
    "s_planned_span": f"""
        SELECT {P}, min(gift_date) AS first_gift_date, max(gift_date) AS last_gift_date
        FROM s_ledger WHERE re_gift_type = 'Planned Gift' GROUP BY {P}""",
    "s_planned_dates": f"""
        SELECT cg.gift_fact_id, min(CASE
            WHEN o.gift_fact_id IS NOT NULL THEN g.gift_date
            WHEN cg.gift_date >= p.last_gift_date THEN p.last_gift_date
            ELSE coalesce(p.first_gift_date, TIMESTAMP '1900-01-01') END) AS planned_gift_date
        FROM s_ledger cg
        JOIN w_gift g ON cg.gift_fact_id = g.gift_fact_id AND cg.{P} = g.{P}
        LEFT JOIN s_planned_span p ON cg.{P} = p.{P}
        LEFT JOIN w_gift o ON g.planned_gift_id = o.gift_system_id
        WHERE cg.gift_fact_id IN (SELECT gift_fact_id FROM w_gift_attribute
          WHERE attribute_category = 'Planned Gift Realized')
        GROUP BY cg.gift_fact_id""",
    "s_realized": """
        SELECT q.gift_fact_id, q.planned_gift_date, d.fiscal_year AS planned_gift_fiscal_year
        FROM s_planned_dates q
        JOIN w_calendar d ON CAST(q.planned_gift_date AS DATE) = d.actual_date""",
    "s_project17": _projected(2017, "2016-07-01"),
    "s_project16": _projected(2016, "2015-07-01"),
    "s_credits": f"SELECT DISTINCT {P}, gift_fact_id FROM s_ledger",
    "s_gift_rows": f"""
        SELECT cg.*, o.gift_fact_id AS commitment_gift_fact_id, d.fiscal_year AS pledge_fiscal_year,
          cr.gift_fact_id IS NOT NULL AS is_credited, r.planned_gift_fiscal_year,
          CASE WHEN cg.re_gift_type IN ('Pledge', 'MG Pledge')
              THEN coalesce(gc.amount, 0) - coalesce(gc.write_off_amount, 0)
            WHEN cg.re_gift_type = 'Recurring Gift'
              THEN coalesce(rg.amount, 0) - coalesce(rg.write_offs, 0)
            WHEN cg.re_gift_type = 'Planned Gift' THEN g.amount
            ELSE cg.amount END AS countable
        FROM s_ledger cg
        JOIN w_gift g ON cg.gift_fact_id = g.gift_fact_id
        LEFT JOIN w_recurring_gift rg ON cg.gift_fact_id = rg.gift_fact_id
        LEFT JOIN w_gift_commitment gc ON cg.gift_fact_id = gc.gift_fact_id
        LEFT JOIN w_installment_payment ip ON cg.gift_fact_id = ip.gift_payment_fact_id
        LEFT JOIN w_gift o ON ip.gift_commitment_system_id = o.gift_system_id
        LEFT JOIN w_calendar d ON o.gift_date_dim_id = d.date_dim_id
        LEFT JOIN s_credits cr ON cg.{P} = cr.{P} AND o.gift_fact_id = cr.gift_fact_id
        LEFT JOIN s_realized r ON cg.gift_fact_id = r.gift_fact_id""",
    "s_strict_years": "SELECT unnest([2016, 2017]) AS fy",
    "s_grace_years": "SELECT unnest(range(2006, 2016)) AS fy",
    "s_strict_rows": f"""
        SELECT g.*, CAST(y.fy AS INT) AS fy, {_status(False)} AS status
        FROM s_gift_rows g JOIN s_strict_years y ON g.gift_fiscal_year = y.fy""",
    "s_grace_rows": f"""
        SELECT g.*, CAST(y.fy AS INT) AS fy, {_status(True)} AS status
        FROM s_gift_rows g JOIN s_grace_years y
          ON g.gift_date BETWEEN make_timestamp(y.fy - 1, 7, 1, 0, 0, 0)
            AND make_timestamp(y.fy, 7, 20, 0, 0, 0)""",
    "s_strict": _first_per_payment("s_strict_rows"),
    "s_grace": _first_per_payment("s_grace_rows"),
    "s_projected_rows": f"""
        SELECT {P}, gift_fiscal_year AS fy, amount AS countable, 'Include' AS status
        FROM s_project17 WHERE gift_fiscal_year IN (SELECT fy FROM s_strict_years)""",
    "s_giving_strict": _totals("s_strict", "s_projected_rows"),
    "s_giving_grace": _totals("s_grace"),
    "s_giving": "SELECT * FROM s_giving_strict UNION ALL SELECT * FROM s_giving_grace",
    "s_solicitable": """
        SELECT fund_dim_id, fund_identifier FROM w_fund
        WHERE fund_identifier IN (SELECT designation FROM w_solicitable_fund)""",
    "s_translation": """
        SELECT fund_identifier, min(suggested_fund_identifier) AS suggested_fund_identifier
        FROM w_fund_translation GROUP BY fund_identifier""",
    "s_production_gifts": f"""
        SELECT p.ocpr_dim_id, p.{P}, p.gift_type, p.fund_identifier,
          CASE WHEN s.fund_identifier IS NOT NULL THEN s.fund_identifier
            WHEN t.fund_identifier IS NOT NULL THEN t.suggested_fund_identifier
            ELSE p.fund_identifier END AS fund_identifier_trans,
          p.cgpr_amount AS amount, p.gift_date, p.fiscal_year,
          CASE WHEN p.gift_type = 'MG Pledge' THEN 'Yes'
            WHEN p.gift_type = 'Other' AND p.gift_sub_type = 'Recognition Credit'
              AND p.cg_gift_type LIKE '%MatchingGift' THEN 'Yes' ELSE 'No' END AS is_matching_gift,
          p.is_ag_gift, f.is_inactive, a.appeal_identifier,
          a.campaign_identifier AS appeal_campaign
        FROM w_production p
        JOIN w_gift g ON p.gift_fact_id = g.gift_fact_id
        JOIN w_fund f ON g.fund_dim_id = f.fund_dim_id
        LEFT JOIN w_appeal a ON g.appeal_dim_id = a.appeal_dim_id
        LEFT JOIN s_solicitable s ON p.fund_identifier = s.fund_identifier
        LEFT JOIN s_translation t ON p.fund_identifier = t.fund_identifier
        WHERE ((p.data_source = 'Development' AND p.measure = 'Production')
            OR p.data_source IN ('OSUAA Membership Dues', 'Recognition Credit'))
          AND p.key_indicator = 'I' AND p.is_deceased = 'No' AND p.cgpr_amount > 0""",
    "s_include": f"""
        SELECT q.{P} FROM (
          SELECT {P} FROM s_giving WHERE fiscal_year IN (2016, 2017)
          UNION
          SELECT {P} FROM w_production WHERE {ANNUAL} AND fiscal_year BETWEEN 2006 AND 2017) q
        JOIN w_primary_code pc ON q.{P} = pc.{P}
        WHERE pc.constituent_code IN ('Alumni', 'Attended', 'Friend')""",
    "s_never": f"""
        SELECT c.{P} FROM w_constituent c
        WHERE EXISTS (SELECT 1 FROM w_primary_code pc
            WHERE pc.{P} = c.{P} AND pc.constituent_code = 'Friend')
          AND EXISTS (SELECT 1 FROM w_constituent_code cc WHERE cc.{P} = c.{P}
            AND cc.constituent_code IN
              ('CVHS Client', 'OSUAA Legacy - Former', 'Faculty/Staff - Former'))
          AND NOT EXISTS (SELECT 1 FROM w_financial_information fi WHERE fi.{P} = c.{P}
            AND fi.information_type = 'Lifetime Comprehensive Giving'
            AND fi.information_source = 'OSU Foundation' AND fi.value > 0)""",
    "s_unmailable": f"""
        SELECT * FROM (SELECT c.{P}, CASE
            WHEN c.{P} IN (SELECT {P} FROM w_constituent_code WHERE constituent_code IN
              ('On Hold New Record', 'OSUAA Legacy', 'Utility Record')) THEN 'held record'
            WHEN is_a_constituent = 'No' THEN 'not a constituent'
            WHEN is_deceased = 'Yes' THEN 'deceased'
            WHEN no_valid_address = 'Yes' THEN 'no valid address'
            WHEN is_inactive = 'Yes' THEN 'inactive'
            WHEN key_indicator = 'O' THEN 'organisation'
            WHEN send_mail = 'No' THEN 'no mail'
            WHEN coalesce(country, '') NOT IN ('', 'United States') THEN 'foreign country'
            WHEN coalesce(state, '') NOT IN (SELECT state FROM w_us_state) THEN 'foreign state'
            WHEN coalesce(rtrim(address1), '') = '' THEN 'no address'
            WHEN coalesce(rtrim(city), '') = '' THEN 'no city'
            WHEN coalesce(state, '') = '' THEN 'no state'
            WHEN coalesce(rtrim(post_code), '') = '' THEN 'no post code'
            WHEN address1 ILIKE 'Duplicate see #%' OR address1 ILIKE 'See Duplicate #%'
              THEN 'duplicate record'
            WHEN full_name ILIKE '%Anon%#%' THEN 'anonymous'
            WHEN full_name ILIKE 'ID%Unknown' THEN 'unknown name' END AS reason
          FROM w_constituent c WHERE constituent_id IS NOT NULL AND c.{P} <> -1) q
        WHERE reason IS NOT NULL""",
    "s_exclude": f"""
        SELECT {P}, 'position' AS rule FROM w_position WHERE position IN
          ('Principal Gift Prospect', 'Board of Governor-Current', 'Board of Governor Trustee',
           'Board of Governor-Honorary Trustee', 'National Campaign Committee',
           'Executive Campaign Committee')
        UNION SELECT {P}, 'primary code' FROM w_primary_code WHERE constituent_code IN
          ('Contact', 'KOSU Donor', 'Memorial Donor', 'OSUAA Legacy', 'Special Interest Donor',
           'Student', 'Utility Record', 'On Hold Record')
        UNION SELECT {P}, 'staff' FROM w_constituent_code WHERE constituent_code = 'Faculty/Staff'
        UNION SELECT {P}, 'never gave' FROM s_never
        UNION SELECT {P}, 'solicit code' FROM w_constituent_attribute
          WHERE attribute_category = 'Solicit Code' AND attribute_description IN
          ('MF - No OSUF Postal Mail', 'MFS - No OSUF Postal Mail Solicitation',
           'X - Permanent No Contact', 'X3 - No Contact', 'XF - Permanent No Contact from OSUF',
           'XF3 - No Contact from OSUF', 'XSF - Permanent No Solicitation from OSUF',
           'SF - No Solicitation', 'SF1 - No OSUF Solicitation (1yr)')
        UNION SELECT {P}, 'not mailable' FROM s_unmailable""",
    "s_include_wide": _expanded("s_include"),
    "s_exclude_wide": _expanded("s_exclude"),
    "s_household": f"""
        SELECT {P} FROM w_constituent
        WHERE constituent_id IS NOT NULL AND {P} <> -1
          AND constituent_system_id = household_system_id
          AND {P} IN (SELECT {P} FROM s_include_wide)
          AND {P} NOT IN (SELECT {P} FROM s_exclude_wide)""",
    "s_education_rows": f"""
        SELECT e.{P}, e.constituent_education_dim_id, m.major_code AS major,
          TRY_CAST(CASE
            WHEN length(rtrim(e.fuzzy_date_graduated)) = 4
              THEN rtrim(e.fuzzy_date_graduated) || '-05-01'
            WHEN length(rtrim(e.fuzzy_date_graduated)) = 6
              THEN e.fuzzy_date_graduated[1:4] || '-' || e.fuzzy_date_graduated[5:6] || '-01'
            WHEN length(rtrim(e.fuzzy_date_graduated)) = 8
              THEN e.fuzzy_date_graduated[1:4] || '-' || e.fuzzy_date_graduated[5:6] || '-'
                || e.fuzzy_date_graduated[7:8]
            WHEN e.class_year IS NOT NULL THEN CAST(e.class_year AS VARCHAR)[1:4] || '-05-01'
            END AS TIMESTAMP) AS date_graduated,
          d.department, e.school_name,
          CASE WHEN EXISTS (SELECT 1 FROM w_education_attribute t WHERE t.{P} = e.{P}
              AND t.constituent_education_dim_id = e.constituent_education_dim_id
              AND t.attribute_category = 'Degree OSU-Tulsa Commencement Participant'
              AND t.attribute_description = 'Yes') THEN 'OSU-Tulsa'
            WHEN e.school_type = 'Center For Health Sciences - Grad'
              THEN 'OSU-Center for Health Sciences'
            ELSE e.school_type END AS school_type
        FROM w_education e
        JOIN w_constituent c ON e.{P} = c.{P}
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {P}, constituent_education_dim_id
            ORDER BY sequence, major_code) AS seq FROM w_education_major) m
          ON e.{P} = m.{P} AND e.constituent_education_dim_id = m.constituent_education_dim_id
            AND m.seq = 1
        LEFT JOIN (SELECT {P}, constituent_education_dim_id, attribute_description AS department,
            row_number() OVER (PARTITION BY {P}, constituent_education_dim_id
              ORDER BY sequence, attribute_description) AS seq
            FROM w_education_attribute WHERE attribute_category = 'Degree Department') d
          ON e.{P} = d.{P} AND e.constituent_education_dim_id = d.constituent_education_dim_id
            AND d.seq = 1
        WHERE e.school_name IN ('Oklahoma State University', 'OSU-Oklahoma City',
            'OSU-Center for Health Sciences', 'OSU-Institute of Technology')
          AND e.is_primary = 'Yes' AND e.school_type <> 'Unknown' AND c.is_deceased = 'No'""",
    "s_recoded": """
        SELECT *, CASE school_type
            WHEN 'CEAT' THEN 'CEAT' WHEN 'SSB' THEN 'Business'
            WHEN 'A&S' THEN 'Arts and Sciences' WHEN 'CASNR' THEN 'DASNR'
            WHEN 'COHS' THEN 'Human Sciences' WHEN 'OSU-Oklahoma City' THEN 'OSU-OKC'
            WHEN 'OSU-Institute of Technology' THEN 'OSU-Institute of Technology'
            WHEN 'COE' THEN 'College of Education' WHEN 'OSU-Tulsa' THEN 'OSU-Tulsa'
            WHEN 'CVHS' THEN 'CVHS' WHEN 'OSU-Center for Health Sciences' THEN 'OSUCHS'
            WHEN 'Graduate College' THEN 'Graduate College'
            WHEN 'SIS' THEN 'SIS (School of International Studies)'
            ELSE school_type END AS school_type_trans
        FROM s_education_rows""",
    "s_education": f"""
        SELECT * FROM s_recoded r WHERE constituent_education_dim_id =
          (SELECT min(x.constituent_education_dim_id) FROM s_recoded x WHERE x.{P} = r.{P})""",
    "s_clean_phone": """
        SELECT * FROM w_phone
        WHERE NOT (phone_type ILIKE '%Email%' OR phone_type ILIKE '%WebSite%'
            OR phone_type ILIKE '%Facebook%' OR phone_type ILIKE '%LinkedIn%'
            OR phone_type ILIKE '%Pager%' OR phone_type ILIKE '%Foreign%'
            OR phone_type ILIKE '%Twitter%' OR phone_type ILIKE '%My Space%'
            OR phone_type ILIKE '%MySpace%' OR phone_type ILIKE '%Fax%')
          AND NOT (phone_number ILIKE '%@%' OR phone_number ILIKE '%00000000%'
            OR phone_number ILIKE '%Print%' OR phone_number ILIKE '%www%'
            OR phone_number ILIKE '%http%' OR phone_number ILIKE '%.com%')
          AND length(regexp_replace(phone_number, '[ ().-]', '', 'g')) >= 7""",
    "s_home_phone": _phone("home", HOME_STEPS, ["Home", "Phone"]),
    "s_cell_phone": _phone("cell", CELL_STEPS, ["Home Cell"]),
    "s_contact_sheet": f"""
        SELECT c.{P}, h.phone_number AS home_phone, m.phone_number AS home_cell
        FROM w_constituent c
        LEFT JOIN s_home_phone h ON c.{P} = h.{P}
        LEFT JOIN s_cell_phone m ON c.{P} = m.{P}
        WHERE c.constituent_id IS NOT NULL AND c.{P} <> -1 AND {ACTIVE.format(c="c")}""",
    "s_phones": "SELECT * FROM s_contact_sheet WHERE coalesce(home_phone, home_cell) IS NOT NULL",
    "s_donor_type": f"""
        SELECT c.{P}, dt.dpag_donor_type_bucket, dt.fiscal_year
        FROM w_donor_type dt JOIN w_constituent c
          ON dt.constituent_system_id = c.constituent_system_id
        WHERE {ACTIVE.format(c="c")} AND dt.fiscal_year = 2017""",
    "s_employer": f"""
        SELECT {P}, full_name, position FROM (
          SELECT r.{P}, e.full_name, r.position, row_number() OVER (PARTITION BY r.{P}
              ORDER BY r.related_constituent_dim_id, r.position NULLS LAST) AS seq
          FROM w_relationship r JOIN w_constituent e ON r.related_constituent_dim_id = e.{P}
          WHERE r.relationship = 'Employer' AND r.reciprocal = 'Employee'
            AND r.is_primary = 'Yes' AND e.full_name <> 'Employer Unknown') q
        WHERE seq = 1""",
    "s_loyalty": f"""
        SELECT {P}, attribute_description AS loyalty_years FROM (
          SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY
              TRY_CAST(attribute_description AS BIGINT) NULLS LAST, attribute_description) AS seq
          FROM w_constituent_attribute
          WHERE attribute_category = 'Loyalty Giving' AND comments = 'OSU Foundation') q
        WHERE seq = 1""",
    "s_recency": _fund_rank("max(gift_date)", "gift_date"),
    "s_money": _fund_rank("sum(amount)", "amount"),
    "s_frequency": _fund_rank("count(*)", "gift_count"),
    "s_points": f"""
        SELECT {P}, fund_identifier_trans, total_points, row_number() OVER (PARTITION BY {P}
            ORDER BY total_points DESC, fund_identifier_trans) AS seq
        FROM (SELECT {P}, fund_identifier_trans, CAST(sum(5 - seq) AS INT) AS total_points
              FROM (SELECT {P}, fund_identifier_trans, seq FROM s_recency WHERE seq <= 4
                    UNION ALL
                    SELECT {P}, fund_identifier_trans, seq FROM s_frequency WHERE seq <= 4
                    UNION ALL
                    SELECT {P}, fund_identifier_trans, seq FROM s_money WHERE seq <= 4) u
              GROUP BY {P}, fund_identifier_trans) q""",
    "s_cascade": _cascade(),
    "s_control": f"""
        SELECT p.{P}, f.fund_identifier, f.fund_description, 1 AS designations_order,
          'AG fund that were given to most by amount' AS data_source
        FROM s_money p JOIN w_fund f ON p.fund_identifier_trans = f.fund_identifier WHERE p.seq = 1
        UNION ALL
        SELECT p.{P}, f.fund_identifier, f.fund_description, CAST(p.seq + 1 AS INT), '3 Most AG funds that were given to most frequently'
        FROM s_frequency p JOIN w_fund f ON p.fund_identifier_trans = f.fund_identifier
        WHERE p.seq <= 3
        UNION ALL SELECT * FROM s_cascade""",
    "s_test": f"""
        SELECT p.{P}, f.fund_identifier, f.fund_description,
          CAST(p.seq AS INT) AS designations_order, 'First three items for the test fund array' AS data_source
        FROM s_points p JOIN w_fund f ON p.fund_identifier_trans = f.fund_identifier
        WHERE p.seq <= 4
        UNION ALL SELECT * FROM s_cascade""",
    "s_control_ranking": _sequenced("s_control", 2016, 2017),
    "s_final_ranking": _sequenced("s_test", 2015, 2016),
    "s_segment": f"""
        SELECT m.{P}, CASE
            WHEN m.{P} IN (SELECT {P} FROM s_giving
              WHERE fiscal_year IN (2016, 2017) AND amount > 0) THEN '16&17DONOR'
            WHEN dt.dpag_donor_type_bucket = '4+ Year Lapsed' THEN '4PLUS'
            WHEN y.total_years <= 1 THEN '1YRG2-3LAPSED'
            WHEN y.total_years >= 2 THEN '2YRG2-3LAPSED' ELSE '' END AS marketing_segment
        FROM s_household m JOIN s_donor_type dt ON m.{P} = dt.{P}
        LEFT JOIN (SELECT {P}, count(DISTINCT fiscal_year) AS total_years FROM w_production
          WHERE {ANNUAL} GROUP BY {P}) y ON m.{P} = y.{P}""",
    # Half-up average to four decimals in whole numbers, as decimal division
    # rounds it.
    "s_average": f"""
        SELECT {P}, sum_amount, CAST((2 * ten_thousandths + n) // (2 * n) AS DECIMAL(18,0))
            * CAST(0.0001 AS DECIMAL(5,4)) AS avg_amount
        FROM (SELECT {P}, sum(amount) AS sum_amount,
                CAST(sum(amount) * 10000 AS HUGEINT) AS ten_thousandths, count(*) AS n
              FROM s_giving GROUP BY {P}) q""",
    "s_raw_ask": f"""
        SELECT m.{P}, s.marketing_segment, a.avg_amount, {_ask(0)}, {_ask(1)}, {_ask(2)}
        FROM s_household m LEFT JOIN s_segment s ON m.{P} = s.{P}
        LEFT JOIN s_average a ON m.{P} = a.{P}""",
    "s_ask": f"""
        SELECT {P}, CAST({_snap(0)} AS DOUBLE) AS ask_1, CAST({_snap(1)} AS DOUBLE) AS ask_2,
          CAST({_snap(2)} AS DOUBLE) AS ask_3
        FROM s_raw_ask""",
}
STAGES |= {
    f"w_{name}": text.format(**{t: t for t in RETAIL_TABLES}) for name, text in VIEWS.items()
}


def _year_text(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '')"


def _money_text(c: str) -> str:
    return f"coalesce(CAST(CAST(round({c}, 2) AS DECIMAL(19,2)) AS VARCHAR), '')"


def _pivot(source: str, prefix: str) -> tuple[str, str]:
    joins, columns = [], []
    for i in (1, 2, 3):
        joins.append(f"LEFT JOIN {source} {prefix}{i} ON c.{P} = {prefix}{i}.{P}"
                     f" AND {prefix}{i}.seq = {i}")
        columns.append(
            f"coalesce({prefix}{i}.fund_description, '') AS {prefix}_fund_description_{i},"
            f" coalesce({prefix}{i}.fund_identifier, '') AS {prefix}_fund_id_{i}"
        )
    return ", ".join(columns), " ".join(joins)


_suggested = _pivot("s_final_ranking", "suggested")
_frequent = _pivot("s_control_ranking", "frequent")

LEDGER_OUT = f"""cg_fact_id, gift_fact_id, {P}, CAST(amount AS DOUBLE) AS amount, fund,
    gift_fiscal_year, gift_type, gift_date, is_ag_gift, appeal_identifier, re_gift_type"""
GIVING_OUT = f"{P}, fiscal_year, CAST(amount AS DOUBLE) AS amount"
MANAGER_OUT = """coalesce({m}.mgr1, {m}.cl1, {m}.disc_mgr, {m}.disc_cl_mgr, '') AS manager_1,
    coalesce({m}.mgr2, {m}.cl2, '') AS manager_2, coalesce({m}.mgr3, {m}.cl3, '') AS manager_3"""
RANK_OUT = f"{P}, fund_identifier_trans, {{m}}, CAST(seq AS INT) AS seq"
SUGGEST_OUT = f"{P}, fund_identifier, fund_description, designations_order, data_source"


def _violations() -> str:
    checks = [
        ("ledger", "unique", "cg_fact_id", "s_ledger"),
        *[("ledger", "not null", c, "s_ledger") for c in ("gift_fact_id", P, "amount", "fund")],
        ("production gifts", "unique", "ocpr_dim_id", "s_production_gifts"),
        ("primary education", "unique", P, "s_education_rows"),
        ("primary education", "not null", "school_type", "s_education_rows"),
        ("primary education", "not null", "date_graduated", "s_education_rows"),
        ("fund translation", "unique", "fund_identifier", "w_fund_translation"),
        ("giving", "unique", f"{P}, fiscal_year", "s_giving"),
        ("household list", "unique", P, "s_household"),
        ("segments", "unique", P, "s_segment"),
        ("asks", "unique", P, "s_ask"),
        ("phones", "unique", P, "s_phones"),
        ("education", "unique", P, "s_education"),
        ("final ranking", "unique", f"{P}, seq", "s_final_ranking"),
        ("control ranking", "unique", f"{P}, seq", "s_control_ranking"),
        ("constituent", "unique", "constituent_system_id", "w_constituent"),
        ("gift", "unique", "gift_fact_id", "w_gift"),
        ("gift credit", "unique", "gift_fact_id", "w_gift_credit"),
        ("fund", "unique", "fund_identifier", "w_fund"),
        ("calendar", "unique", "actual_date", "w_calendar"),
        ("manager", "unique", P, "w_manager"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{stage}' AS stage, '{rule}' AS rule, '{c}' AS columns, "
        + (
            f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {c} FROM {source}) d)"
            if rule == "unique"
            else f"count(*) - count({c})"
        )
        + f" AS violations FROM {source}"
        for stage, rule, c, source in checks
    )


FINAL: dict[str, str] = {
    "gift_ledger": f"SELECT {LEDGER_OUT} FROM s_ledger",
    "giving_fy_strict": f"SELECT {GIVING_OUT} FROM s_giving_strict",
    "giving_fy_grace": f"SELECT {GIVING_OUT} FROM s_giving_grace",
    "giving_per_fiscal_year": f"SELECT {GIVING_OUT} FROM s_giving",
    "countable_amount": """
        SELECT cg_fact_id, fy AS counted_year, re_gift_type, CAST(countable AS DOUBLE) AS countable
        FROM (SELECT * FROM s_strict UNION ALL SELECT * FROM s_grace) q""",
    "include_status_strict": "SELECT cg_fact_id, fy AS counted_year, status FROM s_strict",
    "include_status_grace": "SELECT cg_fact_id, fy AS counted_year, status FROM s_grace",
    "dedupe_payments": f"""
        SELECT cg_fact_id, {P}, commitment_gift_fact_id, CAST(amount AS DOUBLE) AS amount
        FROM (SELECT g.*, row_number() OVER (PARTITION BY {P}, cg_fact_id
                ORDER BY amount DESC, commitment_gift_fact_id NULLS LAST) AS seq
              FROM s_gift_rows g WHERE commitment_gift_fact_id IS NOT NULL) q
        WHERE seq = 1""",
    "positive_totals": f"""
        SELECT {P}, fund, CAST(sum(amount) AS DOUBLE) AS amount FROM s_ledger
        WHERE amount > 0 GROUP BY {P}, fund HAVING sum(amount) > 0""",
    "credited_commitments": f"SELECT {P}, gift_fact_id FROM s_credits",
    "commitment_lineage": """
        SELECT DISTINCT ip.gift_payment_fact_id AS gift_fact_id,
          o.gift_fact_id AS commitment_gift_fact_id, d.fiscal_year AS pledge_fiscal_year
        FROM w_installment_payment ip
        JOIN w_gift o ON ip.gift_commitment_system_id = o.gift_system_id
        LEFT JOIN w_calendar d ON o.gift_date_dim_id = d.date_dim_id""",
    "realized_planned_date": "SELECT * FROM s_realized",
    "first_last_by_type": "SELECT * FROM s_planned_span",
    "projected_gifts": f"SELECT {LEDGER_OUT} FROM s_project17",
    "projected_gifts_prior": f"SELECT {LEDGER_OUT} FROM s_project16",
    "calendar_misses": """
        SELECT gift_fact_id, planned_gift_date FROM s_planned_dates
        WHERE CAST(planned_gift_date AS DATE) NOT IN (SELECT actual_date FROM w_calendar)""",
    "production_gifts": """
        SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM s_production_gifts""",
    "translate_fund": """
        SELECT f.fund_identifier, coalesce(s.fund_identifier, t.suggested_fund_identifier,
          f.fund_identifier) AS fund_identifier_trans
        FROM w_fund f LEFT JOIN s_solicitable s ON f.fund_identifier = s.fund_identifier
        LEFT JOIN s_translation t ON f.fund_identifier = t.fund_identifier""",
    "solicitable_funds": "SELECT fund_dim_id, fund_identifier FROM s_solicitable",
    "include_list": f"SELECT {P} FROM s_include",
    "exclude_list": f"SELECT {P}, rule FROM s_exclude",
    "never_donor_with_code": f"SELECT {P} FROM s_never",
    "mailability_rules": f"SELECT {P}, reason FROM s_unmailable",
    "expand_to_spouse": f"SELECT {P} FROM s_include_wide",
    "household_list": f"SELECT {P} FROM s_household",
    "pick_one": f"""
        SELECT {P}, constituent_education_dim_id, major_code FROM (
          SELECT *, row_number() OVER (PARTITION BY {P}, constituent_education_dim_id
            ORDER BY sequence, major_code) AS seq FROM w_education_major) q
        WHERE seq = 1""",
    "primary_education": f"""
        SELECT {P}, major, date_graduated, department, school_name, school_type,
          school_type_trans FROM s_education""",
    "fuzzy_date": f"SELECT {P}, constituent_education_dim_id, date_graduated FROM s_education_rows",
    "bad_dates": f"""
        SELECT {P}, fuzzy_date_graduated FROM w_education
        WHERE length(fuzzy_date_graduated) = 6 AND fuzzy_date_graduated LIKE '%13'""",
    "recode": f"SELECT {P}, school_type, school_type_trans FROM s_recoded",
    "clean_phone": f"SELECT {P}, phone_type, phone_number FROM s_clean_phone",
    "best_contact_home": "SELECT * FROM s_home_phone",
    "best_contact_cell": "SELECT * FROM s_cell_phone",
    "contact_sheet": "SELECT * FROM s_contact_sheet",
    "drop_empty": "SELECT * FROM s_phones",
    "donor_type": "SELECT * FROM s_donor_type",
    "primary_employer": "SELECT * FROM s_employer",
    "attribute_lookup": f"""
        SELECT {P}, constituent_education_dim_id, department FROM (
          SELECT {P}, constituent_education_dim_id, attribute_description AS department,
            row_number() OVER (PARTITION BY {P}, constituent_education_dim_id
              ORDER BY sequence, attribute_description) AS seq
          FROM w_education_attribute WHERE attribute_category = 'Degree Department') q
        WHERE seq = 1""",
    "quality_violations": _violations(),
    "duplicate_keys": """
        SELECT fund_identifier, count(*) AS rows FROM w_fund_translation
        GROUP BY fund_identifier HAVING count(*) > 1""",
    "rank_recency": f"SELECT {RANK_OUT.format(m='gift_date')} FROM s_recency",
    "rank_money": f"SELECT {RANK_OUT.format(m='CAST(amount AS DOUBLE) AS amount')} FROM s_money",
    "rank_frequency": f"SELECT {RANK_OUT.format(m='gift_count')} FROM s_frequency",
    "points_blend": f"SELECT {RANK_OUT.format(m='total_points')} FROM s_points",
    "rule_cascade": f"SELECT {SUGGEST_OUT} FROM s_cascade",
    "control_suggestions": f"SELECT {SUGGEST_OUT} FROM s_control",
    "test_suggestions": f"SELECT {SUGGEST_OUT} FROM s_test",
    "dedupe_sequence_control": "SELECT * FROM s_control_ranking",
    "dedupe_sequence": "SELECT * FROM s_final_ranking",
    "pivot_top3": f"""
        SELECT c.{P}, max(CASE WHEN seq = 1 THEN fund_description END) AS fund_description_1,
          max(CASE WHEN seq = 1 THEN fund_identifier END) AS fund_id_1,
          max(CASE WHEN seq = 2 THEN fund_description END) AS fund_description_2,
          max(CASE WHEN seq = 2 THEN fund_identifier END) AS fund_id_2,
          max(CASE WHEN seq = 3 THEN fund_description END) AS fund_description_3,
          max(CASE WHEN seq = 3 THEN fund_identifier END) AS fund_id_3
        FROM s_final_ranking c GROUP BY c.{P}""",
    "segment": f"SELECT {P}, marketing_segment FROM s_segment",
    "year_totals": f"""
        SELECT {P},
          CAST(sum(CASE WHEN fiscal_year = 2017 THEN amount ELSE 0 END) AS DOUBLE) AS fy2017,
          CAST(sum(CASE WHEN fiscal_year = 2016 THEN amount ELSE 0 END) AS DOUBLE) AS fy2016
        FROM s_giving GROUP BY {P}""",
    "distinct_years": f"""
        SELECT {P}, count(DISTINCT fiscal_year) AS total_years FROM w_production
        WHERE {ANNUAL} GROUP BY {P}""",
    "avg_per_year": f"""
        SELECT {P}, CAST(sum_amount AS DOUBLE) AS sum_amount, CAST(avg_amount AS DOUBLE) AS avg_amount
        FROM s_average""",
    "ask_ladder": f"""
        SELECT {P}, CAST(ask_1 AS DOUBLE) AS ask_1, CAST(ask_2 AS DOUBLE) AS ask_2,
          CAST(ask_3 AS DOUBLE) AS ask_3 FROM s_raw_ask""",
    "ask_snap": "SELECT * FROM s_ask",
    "last_giving_year": f"""
        SELECT {P}, max(fiscal_year) AS last_year FROM s_production_gifts
        WHERE is_ag_gift = 'Yes' AND is_matching_gift = 'No' GROUP BY {P}""",
    "last_ledger_year": f"""
        SELECT {P}, max(fiscal_year) AS last_year FROM (
          SELECT {P}, gift_fiscal_year AS fiscal_year FROM s_ledger
          UNION SELECT {P}, CAST(2016 AS INT) FROM s_project17) q
        GROUP BY {P}""",
    "last_year_before_report": f"""
        SELECT {P}, max(fiscal_year) AS last_year FROM s_production_gifts
        WHERE amount > 0 AND fiscal_year <> 2017 GROUP BY {P}""",
    "prior_total": f"""
        SELECT {P}, CAST(sum(amount) AS DOUBLE) AS prior_total FROM s_production_gifts
        WHERE amount > 0 AND fiscal_year <> 2017 GROUP BY {P}""",
    "prior_total_last_year": f"""
        SELECT p.{P}, CAST(sum(p.amount) AS DOUBLE) AS prior_total FROM s_production_gifts p
        JOIN (SELECT {P}, max(fiscal_year) AS last_year FROM s_production_gifts
          WHERE amount > 0 AND fiscal_year <> 2017 GROUP BY {P}) y
          ON p.{P} = y.{P} AND p.fiscal_year = y.last_year
        WHERE p.amount > 0 GROUP BY p.{P}""",
    "year_amount": f"SELECT {P}, CAST(amount AS DOUBLE) AS amount FROM s_giving WHERE fiscal_year = 2016",
    "manager_fallback": f"SELECT m.{P}, {MANAGER_OUT.format(m='m')} FROM w_manager m",
    "loyalty_years": f"""
        SELECT c.{P}, CASE WHEN l.{P} IS NULL THEN '0' ELSE l.loyalty_years END AS loyalty_years
        FROM w_constituent c LEFT JOIN s_loyalty l ON c.{P} = l.{P}""",
    "mail_extract": f"""
        SELECT c.constituent_id, c.title, c.first_name, c.surname AS last_name,
          coalesce(c.nickname, '') AS nickname, coalesce(c.suffix, '') AS suffix, c.salutation,
          c.addressee, {MANAGER_OUT.format(m="mn")}, c.address1, c.address2, c.address3,
          c.address4, c.address5, c.city, c.state, c.post_code AS zip,
          coalesce(c.country, '') AS country, 'A17SM-DM' AS appeal_package,
          coalesce(c.email_address, '') AS email, coalesce(e.full_name, '') AS employer,
          coalesce(e.position, '') AS job_title,
          coalesce(s.constituent_id, '') AS spouse_constituent_id,
          coalesce(s.title, '') AS spouse_title, coalesce(s.first_name, '') AS spouse_first_name,
          coalesce(s.surname, '') AS spouse_last_name,
          coalesce(s.nickname, '') AS spouse_nickname, coalesce(s.suffix, '') AS spouse_suffix,
          coalesce(ph.home_phone, '') AS home_phone, coalesce(ph.home_cell, '') AS cell_phone,
          dt.dpag_donor_type_bucket AS donor_type, ny.n AS annual_giving_years,
          {_year_text("la.last_year")} AS last_annual_giving_year,
          {_year_text("ll.last_year")} AS last_gift_year,
          lb.last_year AS last_year_before_report, CAST(pt.total AS DOUBLE) AS prior_total,
          {_money_text("g16.amount")} AS prior_year_amount,
          {_money_text("g17.amount")} AS report_year_amount,
          CASE WHEN lo.{P} IS NULL THEN '0' ELSE lo.loyalty_years END AS loyalty_years,
          coalesce(dt.dpag_donor_type_bucket, '') AS report_year_donor_type,
          {_suggested[0]}, {_frequent[0]}, a.ask_1, a.ask_2, a.ask_3
        FROM w_constituent c
        JOIN s_segment seg ON c.{P} = seg.{P}
        LEFT JOIN w_constituent s ON c.spouse_constituent_system_id = s.constituent_system_id
        LEFT JOIN w_manager mn ON c.{P} = mn.{P}
        LEFT JOIN s_employer e ON c.{P} = e.{P}
        LEFT JOIN s_phones ph ON c.{P} = ph.{P}
        LEFT JOIN s_donor_type dt ON c.{P} = dt.{P}
        LEFT JOIN (SELECT {P}, count(DISTINCT fiscal_year) AS n FROM s_production_gifts
          WHERE amount > 0 AND is_ag_gift = 'Yes' GROUP BY {P}) ny ON c.{P} = ny.{P}
        LEFT JOIN (SELECT {P}, max(fiscal_year) AS last_year FROM s_production_gifts
          WHERE is_ag_gift = 'Yes' AND is_matching_gift = 'No' GROUP BY {P}) la ON c.{P} = la.{P}
        LEFT JOIN (SELECT {P}, max(fiscal_year) AS last_year FROM (
            SELECT {P}, gift_fiscal_year AS fiscal_year FROM s_ledger
            UNION ALL SELECT {P}, 2016 FROM s_project17) u GROUP BY {P}) ll ON c.{P} = ll.{P}
        LEFT JOIN (SELECT {P}, max(fiscal_year) AS last_year FROM s_production_gifts
          WHERE amount > 0 AND fiscal_year <> 2017 GROUP BY {P}) lb ON c.{P} = lb.{P}
        LEFT JOIN (SELECT {P}, sum(amount) AS total FROM s_production_gifts
          WHERE amount > 0 AND fiscal_year <> 2017 GROUP BY {P}) pt ON c.{P} = pt.{P}
        LEFT JOIN s_giving g16 ON c.{P} = g16.{P} AND g16.fiscal_year = 2016
        LEFT JOIN s_giving g17 ON c.{P} = g17.{P} AND g17.fiscal_year = 2017
        LEFT JOIN s_loyalty lo ON c.{P} = lo.{P}
        {_suggested[1]} {_frequent[1]}
        LEFT JOIN s_ask a ON c.{P} = a.{P}""",
    "unsolicitable_funds": f"""
        SELECT DISTINCT f.fund_identifier, f.fund_description,
          coalesce(co.attribute_description, '') AS college,
          coalesce(de.attribute_description, '') AS department
        FROM (
          SELECT n.fund_identifier FROM s_control_ranking n JOIN s_segment m ON n.{P} = m.{P}
          WHERE n.seq <= 10 AND m.marketing_segment <> 'Test Array'
          UNION
          SELECT n.fund_identifier FROM s_final_ranking n JOIN s_segment m ON n.{P} = m.{P}
          WHERE n.seq <= 10 AND m.marketing_segment = 'Test Array') d
        JOIN w_fund f ON d.fund_identifier = f.fund_identifier
        LEFT JOIN w_fund_attribute co ON f.fund_dim_id = co.fund_dim_id
          AND co.attribute_category = 'College'
        LEFT JOIN w_fund_attribute de ON f.fund_dim_id = de.fund_dim_id
          AND de.attribute_category = 'Department'
        WHERE d.fund_identifier NOT IN (SELECT fund_identifier FROM s_solicitable)""",
    "unmapped_translations": """
        SELECT t.fund_identifier, t.suggested_fund_identifier FROM w_fund_translation t
        WHERE t.suggested_fund_identifier NOT IN (SELECT designation FROM w_solicitable_fund)""",
}
# other ways to the same rows
FINAL["extract_bucketed"] = FINAL["mail_extract"]
FINAL["giving_incremental"] = FINAL["giving_per_fiscal_year"]


def _years(source: str, condition: str) -> str:
    return f"""
        SELECT {P}, CAST(fiscal_year // 64 AS INTEGER) AS word,
          bit_or(1::BIGINT << (fiscal_year % 64)) AS bits FROM {source} WHERE {condition} GROUP BY ALL"""


FINAL["year_bitmaps"] = f"""
        SELECT {P}, word, coalesce(own.bits, 0) AS own_annual, coalesce(given.bits, 0) AS positive
        FROM ({_years("s_production_gifts", "is_ag_gift = 'Yes' AND is_matching_gift = 'No'")}) own
        FULL JOIN ({_years("s_production_gifts", "amount > 0")}) given USING ({P}, word)"""
FINAL["year_figures"] = f"""
        SELECT p.{P}, y.n AS total_years, own.latest AS last_annual_giving_year,
          b.latest AS last_year_before_report,
          p.{P} IN (SELECT {P} FROM s_giving WHERE amount > 0 AND fiscal_year IN (2017, 2016)) AS is_current
        FROM (
          SELECT {P} FROM s_production_gifts WHERE amount > 0
            OR (is_ag_gift = 'Yes' AND is_matching_gift = 'No')
          UNION SELECT {P} FROM w_production WHERE {ANNUAL}
          UNION SELECT {P} FROM s_giving WHERE amount > 0
        ) p
        LEFT JOIN (SELECT {P}, count(DISTINCT fiscal_year) AS n FROM w_production
          WHERE {ANNUAL} GROUP BY {P}) y ON p.{P} = y.{P}
        LEFT JOIN (SELECT {P}, max(fiscal_year) AS latest FROM s_production_gifts
          WHERE is_ag_gift = 'Yes' AND is_matching_gift = 'No' GROUP BY {P}) own ON p.{P} = own.{P}
        LEFT JOIN (SELECT {P}, max(fiscal_year) AS latest FROM s_production_gifts
          WHERE amount > 0 AND fiscal_year <> 2017 GROUP BY {P}) b ON p.{P} = b.{P}"""
FINAL["fund_years"] = f"""
        SELECT {P}, fund_identifier, count(DISTINCT fiscal_year) AS total_years,
          max(fiscal_year) AS last_year
        FROM s_production_gifts WHERE amount > 0 GROUP BY {P}, fund_identifier"""


FINAL["giving_from_windows"] = FINAL["giving_per_fiscal_year"]
FINAL["extract_positions"] = f"""
        SELECT constituent_id, row_number() OVER (ORDER BY CAST(constituent_id AS BIGINT), constituent_id)
          AS position FROM ({FINAL["mail_extract"]}) x"""
FINAL["extract_order"] = f"""
        SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS misplaced,
          CAST(0 AS BIGINT) AS overlapping FROM ({FINAL["mail_extract"]}) x"""


def _ambiguous(stage: str, source: str, keys: str, measure: str, direction: str, values: str) -> str:
    """Pairs of first and second row by a self-join, not by the operator's top two."""
    key = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys.split(", "))
    shown = ", ".join(f"coalesce(CAST({v} AS VARCHAR), '')" for v in values.split(", "))
    order = ", ".join(f"{v} NULLS LAST" for v in values.split(", "))
    ranked = f"""(SELECT concat_ws('|', {key}) AS key, {measure} AS measure,
          concat_ws('|', {shown}) AS shown, row_number() OVER (PARTITION BY {keys}
            ORDER BY {measure} {direction}, {order}) AS place FROM ({source}) s)"""
    return f"""
        SELECT '{stage}' AS stage, a.key, a.shown AS picked, b.shown AS other, a.shown <> b.shown AS differ
        FROM {ranked} a JOIN {ranked} b ON a.key = b.key AND a.place = 1 AND b.place = 2
          AND a.measure IS NOT DISTINCT FROM b.measure"""


def _best(source: str, first: int, last: int) -> str:
    return f"""
        SELECT {P}, fund_identifier, fund_description, min(designations_order) AS best FROM {source}
        WHERE {P} IN (SELECT {P} FROM s_giving WHERE fiscal_year BETWEEN {first} AND {last}) GROUP BY ALL"""


_DEGREE = f"{P}, constituent_education_dim_id"
_FUND = "fund_identifier, fund_description"
FINAL["ambiguous_picks"] = " UNION ALL ".join(
    [
        _ambiguous("major", "SELECT * FROM w_education_major", _DEGREE, "sequence", "NULLS FIRST", "major_code"),
        _ambiguous(
            "department",
            "SELECT * FROM w_education_attribute WHERE attribute_category = 'Degree Department'",
            _DEGREE, "sequence", "NULLS FIRST", "attribute_description",
        ),
        _ambiguous(
            "payment",
            f"""SELECT DISTINCT {P}, cg_fact_id, amount, commitment_gift_fact_id FROM s_gift_rows
                WHERE commitment_gift_fact_id IS NOT NULL""",
            f"{P}, cg_fact_id", "amount", "DESC NULLS LAST", "commitment_gift_fact_id",
        ),
        _ambiguous("control ranking", _best("s_control", 2016, 2017), P, "best", "NULLS FIRST", _FUND),
        _ambiguous("final ranking", _best("s_test", 2015, 2016), P, "best", "NULLS FIRST", _FUND),
    ]
)


def _frequent(fact: str, source: str, column: str) -> str:
    return f"""
        SELECT '{fact}' AS fact, '{column}' AS column, CAST({column} AS VARCHAR) AS value, count(*) AS rows
        FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) >= 200"""


FINAL["frequent_keys"] = " UNION ALL ".join(
    [_frequent("gift", "w_gift", c) for c in ("fund_dim_id", "appeal_dim_id", "gift_type_dim_id")]
    + [_frequent("ledger", "s_ledger", c) for c in (P, "fund")]
)


def _blocks(text: str) -> list[str]:
    return [b for b in dict.fromkeys(re.findall(r"\b[sw]_\w+", text)) if b in STAGES]


def oracle(name: str) -> str:
    """The query with the building blocks it needs, innermost first."""
    needed: dict[str, str] = {}

    def add(block: str) -> None:
        if block in needed:
            return
        for inner in _blocks(STAGES[block]):
            add(inner)
        needed[block] = STAGES[block]

    for block in _blocks(FINAL[name]):
        add(block)
    blocks = ",\n".join(f"{b} AS ({text})" for b, text in needed.items())
    return f"WITH {blocks}\n{FINAL[name]}"
