from decimal import Decimal

import pytest

from patronage.operators import lists
from patronage.operators.generic import PERSON
from patronage.operators.giving import annual_giving_years

UNMAILABLE = [
    ({"is_a_constituent": "No"}, "not a constituent"),
    ({"is_deceased": "Yes"}, "deceased"),
    ({"no_valid_address": "Yes"}, "no valid address"),
    ({"is_inactive": "Yes"}, "inactive"),
    ({"key_indicator": "O"}, "organisation"),
    ({"send_mail": "No"}, "no mail"),
    ({"country": "Canada"}, "foreign country"),
    ({"state": "ON"}, "foreign state"),
    ({"state": None}, "foreign state"),
    ({"address1": None}, "no address"),
    ({"address1": "   "}, "no address"),
    ({"city": ""}, "no city"),
    ({"post_code": None}, "no post code"),
    ({"address1": "duplicate SEE #12"}, "duplicate record"),
    ({"address1": "See Duplicate #12"}, "duplicate record"),
    ({"full_name": "The Anonymous Donor #5"}, "anonymous"),
    ({"full_name": "ID 77 Unknown "}, "unknown name"),
    ({"is_deceased": "Yes", "is_inactive": "Yes"}, "deceased"),
    ({"country": None}, None),
    ({"country": ""}, None),
    ({}, None),
]


def ids(df):
    return sorted(r[PERSON] for r in df.select(PERSON).collect())


def test_mailability_branches(table, person):
    people = [person(k, **changes) for k, (changes, _) in enumerate(UNMAILABLE, start=1)]
    held, nobody, dummy = 100, 101, -1
    people += [person(held), person(nobody, constituent_id=None, is_deceased="Yes")]
    people += [person(dummy, is_deceased="Yes")]
    codes = table("constituent_code", [{PERSON: held, "constituent_code": "Utility Record"}] * 2)
    states = table("us_state", [{"state": "OK"}, {"state": None}])
    got = lists.mailability_rules(table("constituent", people), codes, states)
    expected = {k: r for k, (_, r) in enumerate(UNMAILABLE, start=1) if r} | {held: "held record"}
    assert {r[PERSON]: r["reason"] for r in got.collect()} == expected


def test_never_donor_with_code(table, person):
    people = table("constituent", [person(k) for k in range(1, 6)])
    primary = [{PERSON: k, "constituent_code": "Friend"} for k in (1, 2, 3, 4)]
    primary += [{PERSON: 5, "constituent_code": "Alumni"}]
    codes = [{PERSON: k, "constituent_code": "CVHS Client"} for k in (1, 1, 2, 3, 5)]

    def gave(key, value, source="OSU Foundation"):
        kind = "Lifetime Comprehensive Giving"
        return {
            PERSON: key,
            "information_type": kind,
            "information_source": source,
            "value": Decimal(value),
        }

    money = table("financial_information", [gave(2, 5), gave(3, 0), gave(1, 5, "Elsewhere")])
    got = lists.never_donor_with_code(
        people, table("primary_code", primary), table("constituent_code", codes), money
    )
    assert ids(got) == [1, 3]


@pytest.fixture
def couples(table, person):
    """1+2 and 3+4 are couples headed by 1 and 3; 5 is married to 6, who has no id;
    7 is single; 8's household is headed by 7."""

    def couple(a, b):
        return [
            person(a, spouse_constituent_system_id=b),
            person(b, spouse_constituent_system_id=a, household_system_id=a),
        ]

    people = couple(1, 2) + couple(3, 4) + couple(5, 6)
    people[5]["constituent_id"] = None
    people += [person(7), person(8, household_system_id=7)]
    return table("constituent", people)


def members(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], f"{PERSON} bigint")


def test_expand_to_spouse(spark, couples):
    pairs = lists.spouse_pairs(couples)
    assert ids(lists.expand_to_spouse(members(spark, 1, 5, 7), pairs)) == [1, 2, 5, 7]
    assert ids(lists.expand_to_spouse(members(spark, 1, 2), pairs)) == [1, 2]


def test_household_list(spark, couples):
    include, exclude = members(spark, 2, 3, 5, 7, 8), members(spark, 4)
    assert ids(lists.household_list(include, exclude, couples)) == [1, 5, 7]


def test_include_list(spark, table):
    giving = spark.createDataFrame(
        [(1, 2016, 5), (2, 2015, 5), (3, 2017, 5)], f"{PERSON} bigint, fiscal_year int, amount int"
    )

    def gift(key, **more):
        row = {
            PERSON: key,
            "is_ag_gift": "Yes",
            "fiscal_year": 2010,
            "cgpr_amount": Decimal(1),
            "data_source": "Development",
        }
        return {**row, **more}

    production = table(
        "production",
        [
            gift(4),
            gift(5, fiscal_year=2005),
            gift(6, is_ag_gift="No"),
            gift(7, cgpr_amount=Decimal(0)),
            gift(8, data_source="Outside"),
            gift(1),
        ],
    )
    codes = [{PERSON: k, "constituent_code": "Alumni"} for k in (1, 2, 4, 5, 6, 7, 8)]
    codes += [{PERSON: 3, "constituent_code": "Student"}]
    annual = annual_giving_years(production)
    assert ids(lists.include_list(giving, annual, table("primary_code", codes))) == [1, 4]


def test_exclude_list_names_each_rule_once(table, person):
    people = [person(k) for k in range(1, 7)] + [person(7, send_mail="No")]
    got = lists.exclude_list(
        table("constituent", people),
        table(
            "primary_code",
            [
                {PERSON: 1, "constituent_code": "Student"},
                {PERSON: 5, "constituent_code": "Friend"},
                {PERSON: 6, "constituent_code": "Alumni"},
            ],
        ),
        table("position", [{PERSON: 2, "position": "Principal Gift Prospect"}] * 2),
        table(
            "constituent_code",
            [
                {PERSON: 3, "constituent_code": "Faculty/Staff"},
                {PERSON: 5, "constituent_code": "CVHS Client"},
            ],
        ),
        table("financial_information", []),
        table(
            "constituent_attribute",
            [
                {
                    PERSON: 4,
                    "attribute_category": "Solicit Code",
                    "attribute_description": "X3 - No Contact",
                },
                {
                    PERSON: 6,
                    "attribute_category": "Hobby",
                    "attribute_description": "X3 - No Contact",
                },
            ],
        ),
        table("us_state", [{"state": "OK"}]),
    )
    assert sorted((r[PERSON], r["rule"]) for r in got.collect()) == [
        (1, "primary code"),
        (2, "position"),
        (3, "staff"),
        (4, "solicit code"),
        (5, "never gave"),
        (7, "not mailable"),
    ]


def test_list_and_exclusions_are_disjoint(plan):
    listed, excluded = plan.household_list, plan.exclude_list.select(PERSON)
    assert listed.count() > 0
    assert listed.join(excluded, PERSON, "left_semi").count() == 0
