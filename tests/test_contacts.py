from datetime import datetime

import pytest

from patronage.operators import contacts, generic, quality
from patronage.operators.generic import PERSON
from patronage.policy import CELL_PHONE, HOME_PHONE


@pytest.fixture
def phones(table):
    """{person: [(address type, preferred, phone type, number)]} -> the two tables."""

    def make(people):
        addresses, numbers, key = [], [], 0
        for person, entries in people.items():
            for address_type, preferred, phone_type, number in entries:
                key += 1
                ids = {PERSON: person, "constituent_address_system_id": key}
                addresses.append({**ids, "address_type": address_type, "preferred": preferred})
                numbers.append({**ids, "phone_type": phone_type, "phone_number": number})
        return table("address", addresses), table("phone", numbers)

    return make


GOOD = "(405) 555-1234"


def best(phones, people, policy=HOME_PHONE):
    rows = contacts.best_contact(*phones(people), policy).collect()
    assert len(rows) == len({r[PERSON] for r in rows})
    return {r[PERSON]: (r["phone_type"], r["phone_number"]) for r in rows}


def test_home_phone_ladder(phones):
    people = {
        1: [("Home", "No", "Home", "405-555-0001"), ("Home", "Yes", "Home", "405-555-0002")],
        2: [("Home", "Yes", "Phone", GOOD), ("Home", "No", "Home", GOOD)],
        3: [("Home", "Yes", "PhoneFinder2", GOOD), ("Home", "No", "Home 4", GOOD)],
        4: [("Home", "Yes", "PhoneFinder10", GOOD), ("Home", "Yes", "PhoneFinder9", GOOD)],
        5: [("Home", "Yes", "Local Phone", GOOD)],
        6: [("Home", "Yes", "Phone 7", GOOD)],
        7: [("Business", "Yes", "Home", GOOD)],
        8: [("Home", None, "Home", "405-555-0009"), ("Home", "No", "Home", "405-555-0008")],
    }
    assert best(phones, people) == {
        1: ("Home", "405-555-0002"),
        2: ("Home", GOOD),
        3: ("Home 4", GOOD),
        4: ("PhoneFinder9", GOOD),
        8: ("Home", "405-555-0008"),
    }


def test_cell_phone_ladder(phones):
    people = {
        1: [("Home", "No", "Home Cell", GOOD), ("Home", "Yes", "Home Cell 2", GOOD)],
        2: [("Home", "Yes", "AlumniSync Cell", GOOD)],
        3: [("Home", "Yes", "Home", GOOD)],
    }
    assert best(phones, people, CELL_PHONE) == {1: ("Home Cell", GOOD)}


@pytest.mark.parametrize(
    ("phone_type", "number", "kept"),
    [
        ("Home", GOOD, True),
        ("Home", "555-123", False),
        ("Home", "(5) 55.12-34", True),
        ("Home Fax", GOOD, False),
        ("home email", GOOD, False),
        ("My Space", GOOD, False),
        ("Home", "someone@example.org", False),
        ("Home", "000000001", False),
        ("Home", "WWW.example.org", False),
        ("Home", None, False),
        (None, GOOD, False),
    ],
)
def test_clean_phone_filter(spark, phone_type, number, kept):
    row = spark.createDataFrame([(phone_type, number)], "phone_type string, phone_number string")
    assert row.where(contacts.clean_phone_filter()).count() == kept


def test_contact_sheet_and_drop_empty(table, person, phones):
    people = [person(k) for k in (1, 2, 3)] + [person(4, is_deceased="Yes"), person(-1)]
    people += [person(5, constituent_id=None)]
    numbers = {
        1: [("Home", "Yes", "Home", GOOD)],
        2: [("Home", "Yes", "Home Cell", GOOD)],
        4: [("Home", "Yes", "Home", GOOD)],
        5: [("Home", "Yes", "Home", GOOD)],
    }
    sheet = contacts.contact_sheet(table("constituent", people), *phones(numbers))
    assert sheet.count() == 3
    kept = {(r[PERSON], r["home_phone"], r["home_cell"]) for r in contacts.reachable(sheet).collect()}
    # A cell phone also starts with "Home" but is not on the home ladder.
    assert kept == {(1, GOOD, None), (2, None, GOOD)}


@pytest.fixture
def degrees(table, person):
    def degree(person_key, key, **more):
        row = {
            PERSON: person_key,
            "constituent_education_dim_id": key,
            "school_name": "Oklahoma State University",
            "school_type": "SSB",
            "is_primary": "Yes",
            "fuzzy_date_graduated": "1999",
        }
        return {**row, **more}

    def item(person_key, key, sequence, **more):
        return {
            PERSON: person_key,
            "constituent_education_dim_id": key,
            "sequence": sequence,
            **more,
        }

    people = [person(k) for k in (1, 2, 3, 4, 5)] + [person(6, is_deceased="Yes")]
    department = {"attribute_category": "Degree Department"}
    tulsa = "Degree OSU-Tulsa Commencement Participant"
    return (
        table(
            "education",
            [
                degree(1, 10),
                degree(1, 11, school_type="CEAT"),
                degree(2, 20, is_primary="No"),
                degree(3, 30, school_type="Unknown"),
                degree(4, 40, school_type="Center For Health Sciences - Grad"),
                degree(5, 50, school_name="Elsewhere"),
                degree(6, 60),
                degree(2, 21, school_type="COE"),
            ],
        ),
        table("constituent", people),
        table(
            "education_major",
            [
                item(1, 10, 2, major_code="ART"),
                item(1, 10, 1, major_code="MATH"),
                item(1, 10, 1, major_code="BIO"),
            ],
        ),
        table(
            "education_attribute",
            [
                item(1, 10, 2, attribute_description="Later", **department),
                item(1, 10, 1, attribute_description="First", **department),
                item(1, 10, 0, attribute_category="Other", attribute_description="No"),
                item(2, 21, 1, attribute_category=tulsa, attribute_description="Yes"),
                item(4, 40, 1, attribute_category=tulsa, attribute_description="No"),
            ],
        ),
    )


def test_primary_education(degrees):
    got = {r[PERSON]: r for r in contacts.primary_education(*degrees).collect()}
    assert set(got) == {1, 2, 4}
    first = got[1]
    assert (first["major"], first["department"], first["school_type_trans"]) == (
        "BIO",
        "First",
        "Business",
    )
    assert first["date_graduated"] == datetime(1999, 5, 1)
    assert got[2]["school_type_trans"] == "OSU-Tulsa"
    assert (got[4]["school_type"], got[4]["school_type_trans"]) == (
        "OSU-Center for Health Sciences",
        "OSUCHS",
    )


def test_second_primary_degree_is_reported(degrees):
    rows = contacts.primary_education_rows(*degrees)
    assert [tuple(r) for r in quality.duplicate_keys(rows, [PERSON]).collect()] == [(1, 2)]


def test_donor_type(table, person):
    people = [person(1), person(2, is_inactive="Yes"), person(3, key_indicator="O")]
    rows = [
        {"constituent_system_id": k, "dpag_donor_type_bucket": "Current", "fiscal_year": y}
        for k in (1, 2, 3)
        for y in (2016, 2017)
    ]
    got = contacts.donor_type(table("donor_type", rows), table("constituent", people)).collect()
    assert [tuple(r) for r in got] == [(1, "Current", 2017)]


def test_primary_employer_is_one_row_per_person(table, person):
    people = [person(1), person(8, full_name="Employer Unknown"), person(9, full_name="Acme")]

    def job(related, **more):
        row = {
            PERSON: 1,
            "related_constituent_dim_id": related,
            "relationship": "Employer",
            "reciprocal": "Employee",
            "is_primary": "Yes",
        }
        return {**row, **more}

    jobs = [job(8), job(9, position="Clerk"), job(9, position="Boss"), job(9, is_primary="No")]
    got = contacts.primary_employer(table("relationship", jobs), table("constituent", people))
    assert [tuple(r) for r in got.collect()] == [(1, "Acme", "Boss")]


def test_attribute_lookup(table):
    rows = table(
        "constituent_attribute",
        [
            {PERSON: 1, "attribute_category": "Loyalty Giving", "attribute_description": "7", "comments": "OSU Foundation"},
            {PERSON: 1, "attribute_category": "Loyalty Giving", "attribute_description": "9", "comments": "OSU Foundation"},
            {PERSON: 2, "attribute_category": "Loyalty Giving", "attribute_description": "3", "comments": "Other"},
        ],
    )
    assert [tuple(r) for r in contacts.loyalty_years(rows).collect()] == [(1, "7")]


def test_loyalty_years_by_number(table):
    def row(person, value):
        return {PERSON: person, "attribute_category": "Loyalty Giving", "attribute_description": value, "comments": "OSU Foundation"}

    rows = table("constituent_attribute", [row(1, "10"), row(1, "9"), row(2, "many"), row(2, "12"), row(3, "many"), row(3, None)])
    assert sorted(map(tuple, contacts.loyalty_years(rows).collect())) == [(1, "9"), (2, "12"), (3, "many")]


def test_violations(spark):
    rows = spark.createDataFrame([(1, None), (1, "a"), (1, "b"), (2, None)], "k int, v string")
    got = {tuple(r) for r in quality.violations(rows, "stage", ["k"], ["k", "v"]).collect()}
    assert got == {
        ("stage", "unique", "k", 2),
        ("stage", "not null", "k", 0),
        ("stage", "not null", "v", 2),
    }


def test_calendar_misses(spark, table):
    days = table("calendar", [{"date_dim_id": 1, "actual_date": datetime(2015, 1, 1).date()}])
    rows = spark.createDataFrame(
        [(1, datetime(2015, 1, 1, 9)), (2, datetime(2015, 1, 2))], "k int, d timestamp_ntz"
    )
    assert [r["k"] for r in quality.calendar_misses(rows, "d", days).collect()] == [2]


def test_pick_one_sends_one_row_per_key_and_task(spark):
    rows = spark.range(1000).selectExpr("id % 2 AS k", "id")
    picked = generic.pick_one(rows, ["k"], [rows.id.desc()])
    assert sorted(map(tuple, picked.collect())) == [(0, 998), (1, 999)]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
