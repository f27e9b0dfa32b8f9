"""The codes, lists and constants the donor warehouse uses.

Everything below is data that has to equal the warehouse's own values for the
results to be right.  Nothing here is logic; the operators take these values as
parameters (see :mod:`patronage.policy`) and can be given others.
"""

from datetime import date

# --- flags and keys -------------------------------------------------------
YES = "Yes"
NO = "No"
INDIVIDUAL = "I"
ORGANISATION = "O"
UNKNOWN_MEMBER_KEY = -1

# --- fiscal calendar ------------------------------------------------------
FISCAL_YEAR_START_MONTH = 7
STRICT_YEARS = (2016, 2017)
GRACE_YEARS = tuple(range(2006, 2016))
GRACE_LAST_COUNTED_DAY = (7, 20)
GRACE_LAST_EXCLUDED_DAY = (7, 21)
NO_PLANNED_GIFT_DATE = date(1900, 1, 1)
PROJECTION_COMMITTED_BEFORE = {2017: date(2016, 7, 1), 2016: date(2015, 7, 1)}

# --- gift types -----------------------------------------------------------
PLEDGE = "Pledge"
MATCHING_PLEDGE = "MG Pledge"
RECURRING_GIFT = "Recurring Gift"
RECURRING_PAYMENT = "Recurring Gift Pay-Cash"
PLANNED_GIFT = "Planned Gift"
PLEDGE_PAYMENT_PREFIX = "Pay-"
MATCHING_PAYMENT_PREFIX = "MG Pay"
ANNUAL_PROJECTION = "Annual Projection"
REALIZED_ATTRIBUTE = "Planned Gift Realized"
MEMBERSHIP_FUNDS = ("11-00100", "12-00200")

# --- production facts -----------------------------------------------------
DATA_SOURCE_DEVELOPMENT = "Development"
DATA_SOURCES_ALWAYS = ("OSUAA Membership Dues", "Recognition Credit")
MEASURE_PRODUCTION = "Production"
OTHER_GIFT = "Other"
RECOGNITION_CREDIT = "Recognition Credit"
MATCHING_GIFT_SUFFIX = "MatchingGift"
ANNUAL_GIVING_SINCE = 2006

# --- audience codes -------------------------------------------------------
INCLUDED_PRIMARY_CODES = ("Alumni", "Attended", "Friend")
EXCLUDED_POSITIONS = (
    "Principal Gift Prospect",
    "Board of Governor-Current",
    "Board of Governor Trustee",
    "Board of Governor-Honorary Trustee",
    "National Campaign Committee",
    "Executive Campaign Committee",
)
EXCLUDED_PRIMARY_CODES = (
    "Contact",
    "KOSU Donor",
    "Memorial Donor",
    "OSUAA Legacy",
    "Special Interest Donor",
    "Student",
    "Utility Record",
    "On Hold Record",
)
STAFF_CODE = "Faculty/Staff"
FRIEND_CODE = "Friend"
NEVER_DONOR_SECONDARY_CODES = (
    "CVHS Client",
    "OSUAA Legacy - Former",
    "Faculty/Staff - Former",
)
LIFETIME_GIVING_TYPE = "Lifetime Comprehensive Giving"
LIFETIME_GIVING_SOURCE = "OSU Foundation"
SOLICIT_CATEGORY = "Solicit Code"
EXCLUDED_SOLICIT_CODES = (
    "MF - No OSUF Postal Mail",
    "MFS - No OSUF Postal Mail Solicitation",
    "X - Permanent No Contact",
    "X3 - No Contact",
    "XF - Permanent No Contact from OSUF",
    "XF3 - No Contact from OSUF",
    "XSF - Permanent No Solicitation from OSUF",
    "SF - No Solicitation",
    "SF1 - No OSUF Solicitation (1yr)",
)
HELD_RECORD_CODES = ("On Hold New Record", "OSUAA Legacy", "Utility Record")
HOME_COUNTRIES = ("", "United States")
DUPLICATE_ADDRESS_PREFIXES = ("Duplicate see #", "See Duplicate #")
ANONYMOUS_NAME_PATTERN = "%Anon%#%"
UNKNOWN_NAME_PATTERN = "ID%Unknown"

# --- education ------------------------------------------------------------
MAIN_SCHOOL = "Oklahoma State University"
CITY_SCHOOL = "OSU-Oklahoma City"
HEALTH_SCHOOL = "OSU-Center for Health Sciences"
TECHNOLOGY_SCHOOL = "OSU-Institute of Technology"
SCHOOLS = (MAIN_SCHOOL, CITY_SCHOOL, HEALTH_SCHOOL, TECHNOLOGY_SCHOOL)
UNKNOWN_SCHOOL_TYPE = "Unknown"
TULSA_SCHOOL_TYPE = "OSU-Tulsa"
HEALTH_GRAD_SCHOOL_TYPE = "Center For Health Sciences - Grad"
DEPARTMENT_CATEGORY = "Degree Department"
TULSA_CATEGORY = "Degree OSU-Tulsa Commencement Participant"
HONORS_CATEGORY = "Degree Honors Degree"
GRADUATE_DEGREE_FRAGMENTS = ("doc", "mast")
FUZZY_DATE_MONTH_DAY = "-05-01"
SCHOOL_TYPE_RECODE = {
    "CEAT": "CEAT",
    "SSB": "Business",
    "A&S": "Arts and Sciences",
    "CASNR": "DASNR",
    "COHS": "Human Sciences",
    "OSU-Oklahoma City": "OSU-OKC",
    "OSU-Institute of Technology": "OSU-Institute of Technology",
    "COE": "College of Education",
    "OSU-Tulsa": "OSU-Tulsa",
    "CVHS": "CVHS",
    "OSU-Center for Health Sciences": "OSUCHS",
    "Graduate College": "Graduate College",
    "SIS": "SIS (School of International Studies)",
}

# --- phones ---------------------------------------------------------------
HOME_ADDRESS = "Home"
HOME_PHONE_PREFERRED_LADDER = ("Home", "Phone", "Home 2", "Home 3", "Home 4")
HOME_PHONE_OTHER_LADDER = (
    "Local Phone",
    "AlumniSync Phone",
    "AlumniSync Phone 2",
    "AlumniSync Phone 3",
    "PhoneFinder",
) + tuple(f"PhoneFinder{n}" for n in range(2, 21))
HOME_PHONE_PREFIXES = ("Home", "Phone")
CELL_PHONE_PREFERRED_LADDER = ("Home Cell", "Home Cell 2", "Home Cell 3", "Home Cell 4")
CELL_PHONE_OTHER_LADDER = (
    "AlumniSync Cell",
    "AlumniSync Cell 2",
    "AlumniSync Cell 3",
    "AlumniSync Cell 4",
)
CELL_PHONE_PREFIXES = ("Home Cell",)
UNWANTED_PHONE_TYPES = (
    "Email",
    "WebSite",
    "Facebook",
    "LinkedIn",
    "Pager",
    "Foreign",
    "Twitter",
    "My Space",
    "MySpace",
    "Fax",
)
UNWANTED_PHONE_TEXT = ("@", "00000000", "Print", "www", "http", ".com")
PHONE_PUNCTUATION = " ()-."
PHONE_MIN_LENGTH = 7

# --- employer and loyalty -------------------------------------------------
EMPLOYER = "Employer"
EMPLOYEE = "Employee"
UNKNOWN_EMPLOYER = "Employer Unknown"
LOYALTY_CATEGORY = "Loyalty Giving"
LOYALTY_COMMENT = "OSU Foundation"

# --- fund suggestions -----------------------------------------------------
RANK_POINTS = (4, 3, 2, 1)
GENERAL_SCHOLARSHIP_FUND = "20-24400"
GRADUATE_COLLEGE_FUND = "20-94430"
HONORS_COLLEGE_FUND = "20-29300"
HOMECOMING_FUND = "20-90750"
STUDENT_SUCCESS_FUND = "20-73350"
HEALTH_EXCELLENCE_FUND = "31-21500"
HEALTH_SCHOLARSHIP_FUND = "31-22500"
TECHNOLOGY_EXCELLENCE_FUND = "29-93300"
TECHNOLOGY_SCHOLARSHIP_FUND = "29-99970"
CITY_EXCELLENCE_FUND = "30-88500"
CITY_SCHOLARSHIP_FUND = "30-93100"
PET_THERAPY_FUND = "20-81600"
VETERANS_FUND = "20-19650"
CONTROL_AUDIENCE_YEARS = (2016, 2017)
FINAL_AUDIENCE_YEARS = (2015, 2016)

# --- segments and asks ----------------------------------------------------
CURRENT_YEARS = (2016, 2017)
LAPSED_BUCKET = "4+ Year Lapsed"
# Include status of a gift, by what a payment settles: in the promise's own
# year, and in the window after its year's end.
STATUS_INCLUDE = "Include"
STATUS_EXCLUDE_SAME_YEAR = {
    "planned gift": "Exclude - Realized Planned Gift made in the same year as Planned Gift",
    "pledge": "Exclude - Pledge Payment made in the same year as the pledge",
    "recurring gift": "Exclude - Recurring Gift Payment made in the same year as the pledge",
    "matching gift": "Exclude - Matching Gift Payment made in the same year as the pledge",
}
STATUS_EXCLUDE_AFTER_YEAR = {
    "planned gift": "Exclude - Realize Planned Gift made in the following fiscal but up to 7/21",
    "pledge": "Exclude - Pledge Payment made in the following fiscal but up to 7/21",
    "recurring gift": "Exclude - Recurring Gift Payment made in the following fiscal but up to 7/21",
    "matching gift": "Exclude - Matching Gift Payment made in the following fiscal but up to 7/21",
}
# Where a suggestion comes from.
SOURCE_MOST_MONEY = "AG fund that were given to most by amount"
SOURCE_MOST_FREQUENT = "3 Most AG funds that were given to most frequently"
SOURCE_MOST_POINTS = "First three items for the test fund array"
SOURCE_DEPARTMENT = (
    "Const Pri Degree Dept Fund1 (Blank Majors column)",
    "Const Pri Degree Dept Fund2 (Blank Majors column)",
)
SOURCE_SPOUSE_DEPARTMENT = (
    "Spouse Const Pri Degree Dept Fund1 (Blank Majors column)",
    "Spouse Const Pri Degree Dept Fund2 (Blank Majors column)",
)
SOURCE_COLLEGE = (
    "Const Pri Degree College Fund1 (Blank Majors column, Blank Dept Column)",
    "Const Pri Degree College Fund2 (Blank Majors column, Blank Dept Column)",
)
SOURCE_SPOUSE_COLLEGE = (
    "Spouse Pri Degree College Fund1 (Blank Majors column, Blank Dept Column)",
    "Spouse Pri Degree College Fund2 (Blank Majors column, Blank Dept Column)",
)
SEGMENT_CURRENT = "16&17DONOR"
SEGMENT_LAPSED_4PLUS = "4PLUS"
SEGMENT_LAPSED_ONE_YEAR = "1YRG2-3LAPSED"
SEGMENT_LAPSED_MULTI_YEAR = "2YRG2-3LAPSED"
SEGMENT_TEST_ARRAY = "Test Array"
ASK_FLAT = ("100", "50", "25")
ASK_BRACKETS = ("75", "250", "1000")
ASK_FACTORS = {
    "75-250": ("2", "1.1", "0.5"),
    "250-1000": ("1.5", "1.1", "0.5"),
    "1000+": ("1.1", "1", "0.5"),
}
ASK_SNAP = {
    "75-250": ("200", "100", "50"),
    "250-1000": ("1000", "500", "200"),
    "1000+": ("5000", "2500", "1000"),
}
ASK_ROUNDING = 5

# --- extract --------------------------------------------------------------
APPEAL_PACKAGE = "A17SM-DM"
DONOR_TYPE_YEAR = 2017
REPORT_YEAR = 2017
PRIOR_YEAR = 2016
PROJECTION_REPORTED_YEAR = 2016

# Column of the extract -> heading printed in the delivered file.
EXTRACT_HEADINGS = {
    "constituent_id": "ConstituentID",
    "title": "Title",
    "first_name": "First Name",
    "last_name": "Last Name",
    "nickname": "Nickname",
    "suffix": "Suffix",
    "salutation": "Salutation",
    "addressee": "Primary Addressee Format",
    "manager_1": "Manager 1",
    "manager_2": "Manager 2",
    "manager_3": "Manager 3",
    "address1": "Address1",
    "address2": "Address2",
    "address3": "Address3",
    "address4": "Address4",
    "address5": "Address5",
    "city": "City",
    "state": "State",
    "zip": "Zip",
    "country": "Country",
    "appeal_package": "Appeal Code + Package ID",
    "email": "Email",
    "employer": "Employer",
    "job_title": "Job Title",
    "spouse_constituent_id": "Spouse ConstituentID",
    "spouse_title": "Spouse Title",
    "spouse_first_name": "Spouse First Name",
    "spouse_last_name": "Spouse Last Name",
    "spouse_nickname": "Spouse Nickname",
    "spouse_suffix": "Spouse Suffix",
    "home_phone": "Home Phone",
    "cell_phone": "Cell Phone",
    "donor_type": "Annual Giving Donor Type Bucket",
    "annual_giving_years": "Number of years containing an annual giving defined gift",
    "last_annual_giving_year": "Fiscal Year of last Annual Giving defined gift",
    "last_gift_year": "Fiscal Year of last gift",
    "last_year_before_report": "Fiscal year of last gift prior to FY17",
    "prior_total": "Total amount of giving in year of last gift (prior to FY17)",
    "prior_year_amount": "Total Amount of FY16 Giving",
    "report_year_amount": "Total Amount of FY17 Giving",
    "loyalty_years": "OSU Foundation Loyalty Giving Number (or total number of years of giving)",
    "report_year_donor_type": "FY17 Annual Giving Donor Type Bucket",
    "suggested_fund_description_1": "Suggested Fund Description 1",
    "suggested_fund_id_1": "Suggested Fund ID 1",
    "suggested_fund_description_2": "Suggested Fund Description 2",
    "suggested_fund_id_2": "Suggested Fund ID 2",
    "suggested_fund_description_3": "Suggested Fund Description 3",
    "suggested_fund_id_3": "Suggested Fund ID 3",
    "frequent_fund_description_1": "Annual Giving defined fund Description given to most frequently",
    "frequent_fund_id_1": "Annual Giving defined fund ID given to most frequently",
    "frequent_fund_description_2": "Annual Giving defined fund Description given to 2nd most frequently",
    "frequent_fund_id_2": "Annual Giving defined fund ID given to 2nd most frequently",
    "frequent_fund_description_3": "Annual Giving defined fund Description given to 3rd most frequently",
    "frequent_fund_id_3": "Annual Giving defined fund ID given to 3rd most frequently",
    "ask_1": "Ask1",
    "ask_2": "Ask2",
    "ask_3": "Ask3",
}
