"""Code lists, labels and thresholds that results depend on.

Everything here is data, stated once. Operators take these as parameter
defaults (see ``termtrail.params``), never as hidden constants.
"""

# --- program, credit and grade codes -------------------------------------
ESL_PROGRAMS = ("493084", "493085", "493086", "493087")
INTEGRATED_PROGRAM = "493087"
NONCREDIT = "N"
CREDIT_CODES = ("C", "D")
NOT_DROPPED = "19080808"
WITHDRAWN_GRADES = ("W", "FW", "DR")
NOT_PASSED_GRADES = ("W", "NP", "INP", "FW", "DR", "F")
LEVEL_LETTERS = ("A", "B", "C", "D", "E", "F", "G", "H")
UNSPECIFIED_LEVEL = "Y"
TRANSFER_ENGLISH_PROGRAMS = ("150100", "150110", "152000")
TRANSFER_MATH_PROGRAMS = ("170000", "170200", "170100", "170110", "170170")
TRANSFERABLE_STATUS = ("A", "B")
SPECIAL_ADMIT_CODE = "10000"
PELL_AWARD = "GP"
EOPS_AWARD = "GE"

# --- term names -> half-year cohort --------------------------------------
FALL_TERM_NAMES = ("SUMMER TERM", "SUMMER QUARTER", "FALL SEMESTER", "FALL QUARTER", "ANNUAL")
SPRING_TERM_NAMES = ("WINTER INTERSESSION", "WINTER QUARTER", "SPRING SEMESTER", "SPRING QUARTER")

# --- college groups -------------------------------------------------------
GROUP_AB = "CONFIRMED CC - A/B"
GROUP_EF = "CONFIRMED CC - E/F"
GROUP_SIX = "CONFIRMED CC - 6 LEVELS"
GROUP_POSSIBLE = "POSSIBLE CC"
GROUP_OTHER = "Other CC"
CONFIRMED_GROUPS = (GROUP_SIX, GROUP_AB, GROUP_EF)

COLLEGES_AB = (
    "COMPTON", "SANTA ANA", "CUESTA", "SEQUOIAS", "YUBA", "SAN FRANCISCO CITY", "OXNARD",
    "L.A. MISSION", "MENDOCINO", "SANTA MONICA", "CHABOT", "CHAFFEY", "SAN JOSE CITY",
    "EAST L.A.", "MODESTO", "ANTELOPE VALLEY", "SAN FRANCISCO CTRS", "SANTIAGO CANYON",
    "CITRUS", "GLENDALE", "VICTOR VALLEY", "PALO VERDE", "SADDLEBACK", "CONTRA COSTA",
    "FOOTHILL",
)
COLLEGES_EF = (
    "DIABLO VALLEY", "BARSTOW", "MORENO VALLEY", "GOLDEN WEST", "RIO HONDO", "FRESNO CITY",
    "NORCO", "MISSION", "RIVERSIDE", "SIERRA",
)
COLLEGES_SIX = (
    "L.A. CITY", "SAN DIEGO CONTINUING", "ALAMEDA", "NORTH ORANGE CONT", "DESERT", "WOODLAND",
    "MIRA COSTA", "BAKERSFIELD", "GAVILAN", "L.A. HARBOR", "IMPERIAL VALLEY", "LANEY",
    "CERRITOS", "MONTEREY", "L.A. VALLEY", "VENTURA", "MADERA", "DE ANZA", "PALOMAR", "MARIN",
    "REEDLEY", "ORANGE COAST", "WEST VALLEY", "COLUMBIA", "IRVINE VALLEY", "LONG BEACH CITY",
    "ALLAN HANCOCK", "PORTERVILLE", "MT. SAN ANTONIO",
)
COLLEGES_POSSIBLE = (
    "MERRITT", "MERCED", "HARTNELL", "COALINGA", "SHASTA", "COASTLINE", "LAKE TAHOE",
    "PASADENA CITY", "SANTA BARBARA CITY", "CANYONS", "SAN BERNARDINO", "COPPER MOUNTAIN",
    "SANTA ROSA", "SOUTHWEST L.A.", "EL CAMINO", "LOS MEDANOS", "NAPA VALLEY", "LAS POSITAS",
)
COLLEGE_CODES_AB = (
    "141", "291", "311", "361", "363", "422", "472", "482", "561", "592", "621", "641", "682",
    "711", "731", "743", "748", "781", "821", "871", "873", "891", "921", "951", "991",
)
COLLEGE_CODES_EF = (
    "271", "312", "492", "571", "832", "881", "911", "961", "962", "963",
)
GROUP_LETTERS = {GROUP_AB: "A", GROUP_EF: "E", GROUP_SIX: "6", GROUP_POSSIBLE: "P"}
OTHER_GROUP_LETTER = "O"

# --- award descriptions (code -> text) -----------------------------------
AWARD_DESCRIPTIONS = {
    "A": "Associate of Arts (A.A.) degree",
    "S": "Associate of Science (A.S.) degree",
    "Y": "Baccalaureate of Arts (B.A.) degree",
    "Z": "Baccalaureate of Science (B.S.) degree",
    "E": "Credit Certificate requiring fewer than 30 semester units",
    "B": "Credit Certificate requiring fewer than 30 semester units",
    "N": "Credit Certificate requiring fewer than 30 semester units",
    "L": "Credit Certificate requiring fewer than 30 semester units",
    "O": "Credit Certificate requiring fewer than 30 semester units",
    "T": "Credit Certificate requiring 30 to fewer than 60 semester units",
    "F": "Credit Certificate requiring 60 or more semester units",
    "G": "Noncredit award requiring fewer than 48 hours of direct instruction or directly supervised activity",
    "H": "Noncredit award requiring from 48 to fewer than 96 hours of direct instruction or directly supervised activity",
    "I": "Noncredit award requiring from 96 to fewer than 144 hours of direct instruction or directly supervised activity",
    "J": "Noncredit award requiring from 144 to fewer than 192 hours of direct instruction or directly supervised activity",
    "K": "Noncredit award requiring from 192 to fewer than 288 hours of direct instruction or directly supervised activity",
    "P": "Noncredit award requiring from 288 to fewer than 480 hours of direct instruction or directly supervised activity",
    "Q": "Noncredit award requiring from 480 to fewer than 960 hours of direct instruction or directly supervised activity",
    "R": "Noncredit award requiring 960 hours or more of direct instruction or directly supervised activity",
    "U": "Noncredit Adult Education High School Diploma",
}
UNKNOWN_AWARD = "Unknown"

# --- education goal labels used by the analysis base ----------------------
# B and C share one label, as the report tables expect.
GOAL_AT_ENROLLMENT = {
    "A": "Obtain an associate degree and transfer to a four-year institution",
    "B": "Transfer to a 4-year institution without an associate degree",
    "C": "Transfer to a 4-year institution without an associate degree",
    "E": "Earn a vocational certificate without transfer",
    "F": "Discover / formulate career interests, plans, goals",
    "G": "Prepare for a new career (acquire job skills)",
    "H": "Advance in current job / career (update job skills)",
    "I": "Maintain certificate or license (e.g. Nursing, Real Estate)",
    "J": "Educational development (intellectual, cultural)",
    "K": "Improve basic skills in English, reading or math",
    "L": "Complete credits for high school diploma or GED",
    "M": "Undecided on goal",
    "N": "To move from noncredit coursework to credit coursework",
    "O": "4-year college student taking courses to meet 4-year college requirements",
}

# --- report measure names keyed by the code they count --------------------
HIGHEST_ED_MEASURES = {
    "0": "highest_ed_no_high_school",
    "1": "highest_ed_k_12_special_admit",
    "2": "highest_ed_adult_school",
    "3": "highest_ed_high_school_diploma",
    "4": "highest_ed_ged_equivalent",
    "5": "highest_ed_chs_proficiency_certificate",
    "6": "highest_ed_foreign_secondary_school_diploma",
    "7": "highest_ed_associate_degree",
    "8": "highest_ed_bachelor_or_higher_degree",
}
GOAL_MEASURES = {
    "A": "Obtain an AD and transfer to a 4-year institution",
    "B": "Transfer to a 4-year institution without an AD",
    "C": "Transfer to a 4-year institution without an associate degree",
    "E": "Earn a vocational certificate without transfer",
    "F": "Discover / formulate career interests, plans, goals",
    "G": "Prepare for a new career (acquire job skills)",
    "H": "Advance in current job / career (update job skills)",
    "I": "Maintain certificate or license (e.g. Nursing, Real Estate)",
    "J": "Educational development (intellectual, cultural)",
    "K": "Improve basic skills in English, reading or math",
    "L": "Complete credits for high school diploma or GED",
    "M": "Undecided on goal",
    "N": "To move from noncredit coursework to credit coursework",
    "O": "4-year college student taking courses to meet requirements",
}
CITIZENSHIP_MEASURES = {
    "1": "citizenship_earliest_us_citizen",
    "2": "citizenship_earliest_permanent_resident",
    "3": "citizenship_earliest_temporary_resident",
    "4": "citizenship_earliest_refugee_asylee",
    "5": "citizenship_earliest_student_visa",
    "6": "citizenship_earliest_other_status",
}
AGE_MEASURES = {
    "age_at_entry_18_24": (18, 24),
    "age_at_entry_25_44": (25, 44),
    "age_at_entry_45_54": (45, 54),
    "age_at_entry_55_59": (55, 59),
    "age_at_entry_60_plus": (60, 110),
}
UNIVERSES = ("total_uni", "noncred_only_uni", "credit_only_uni", "both_uni")

# --- first-level report ---------------------------------------------------
NEVER_COMPLETED_LABEL = "Never Completed ESL After Enrollment"
ALWAYS_CREDIT_LABEL = "Always Credit ESL"
INTEGRATED_LABEL = "Integrated ESL Course"
OTHER_ISSUE_LABEL = "other issue"

# --- disclosure job -------------------------------------------------------
MIN_CELL = 11
SUPPRESSED = "suppressed"
ENTRY_COHORTS = ("2017-2018", "2018-2019", "2019-2020", "2020-2021", "2021-2022")
CENSORED_COHORT = "2022-2023"
SEQUENCE_COLUMNS = (
    "any_esl_enrollment_by_terms",
    "any_noncredit_esl_enrollment_by_terms",
    "any_credit_esl_enrollment_by_terms",
    "lowest_cb21_level_adjusted_all_by_terms",
    "lowest_cb21_level_adjusted_all_credit_types_by_terms",
    "any_493084_course_enrollment_by_terms",
    "any_493085_course_enrollment_by_terms",
    "any_493086_course_enrollment_by_terms",
    "any_493087_course_enrollment_by_terms",
)
BANNED_SUBSTRINGS = ("uuid", "sb00", "ssn", "name", "birth", "address", "date", "college_id",
                     "district", "gi01")
GROUP_NONCREDIT = "noncredit only"
GROUP_CREDIT = "credit only"
GROUP_MIXED = "mixed"
GROUP_NONE = "no ESL recorded"
STRUCTURE_LABELS = {
    GROUP_SIX: "six levels",
    GROUP_AB: "top two combined",
    GROUP_EF: "two beginning combined",
}
CITIZENSHIP_LABELS = {
    "1": "US citizen",
    "2": "Permanent resident",
    "3": "Temporary resident",
    "4": "Refugee or asylee",
    "5": "Student visa",
    "6": "Other status",
    "X": "Unknown",
}
GOAL_LABELS = {
    "A": "Degree and transfer",
    "B": "Transfer without degree",
    "C": "Degree without transfer",
    "E": "Vocational certificate",
    "F": "Discover career interests",
    "G": "Prepare for a new career",
    "H": "Advance in current job",
    "J": "Educational development",
    "K": "Improve basic skills in English",
    "L": "High school credits or GED",
    "M": "Undecided",
    "N": "Move from noncredit to credit",
    "X": "Not reported",
}
GENDER_LABELS = {"F": "Female", "M": "Male"}
RACE_FLAG_LABELS = {
    "latin_american": "Latin American",
    "aapi": "AAPI",
    "white": "White",
    "black": "Black",
    "indigenous_american": "Indigenous American",
    "no_data": "No race data recorded",
}
PATHWAY_ONE_TERM = "1 One term, then gone"
PATHWAY_SAME_LEVEL = "2 Returns, finishes at the level they started"
PATHWAY_STEADY = "3 Moves up steadily"
PATHWAY_UP_AND_DOWN = "4 Moves up and down the levels"
PATHWAY_TOP = "5 Reaches the top level"
PATHWAY_UNCLASSIFIED = "Not classified"
AT_OR_ABOVE_TRANSFER = "at or above transfer"
AGE_BANDS = (
    ("18 to 24", 14, 24),
    ("25 to 44", 25, 44),
    ("45 to 54", 45, 54),
    ("55 and over", 55, 99),
)
AWARD_FAMILY_CODES = {
    "ESL basic skills": (493084, 493085, 493086, 493087, 493090),
    "Vocational ESL": (493100,),
    "Other basic skills": (493009, 493010, 493011, 493012, 493013, 493014, 493030, 493031,
                           493032, 493033, 493060, 493062, 493072),
    "Liberal arts or transfer studies": (490100, 490110, 490200, 490300, 490310, 490330, 499900),
}
AWARD_FAMILY_DEFAULT = "Career-technical or academic discipline"
LEVEL_VARIANT_NOTE = "all / all_credit_types (NOT the collapsed variant)"
CREDIT_STATUS_NOTE = "derived from per-term ESL sequences"

# --- dashboard labels -----------------------------------------------------
UNKNOWN = "Unknown"
MISSING = "Missing"
OTHER = "Other"
TOTAL = "Total"
YES_VALUES = ("Y", "YES", "TRUE", "1")
NO_VALUES = ("N", "NO", "FALSE", "0")
DASHBOARD_GENDER = {"F": "Female", "M": "Male", "X": "Nonbinary/Unknown"}
DASHBOARD_HISPANIC = {"Y": "Hispanic/Latino", "N": "Not Hispanic/Latino"}
DASHBOARD_RACES = {
    "latin_american": "Latin American",
    "aapi": "AAPI",
    "black": "Black",
    "indigenous_american": "Indigenous American",
    "white": "White",
    "no_data": "No Data",
}
DASHBOARD_AGES = (("Under 24", None, 24), ("25 to 50", 24, 50), ("Over 50", 50, None))
BINARY_FIELDS = (
    "latin_american", "aapi", "black", "indigenous_american", "white", "no_data",
    "english_or_math_enrollment", "special_admit_dual_enrollment", "prior_non_success",
)
EXCLUDED_FIELDS = ("uuid", "zip_code", "residence_aggregated")
FLOW_LEFT = {
    "first_term_credit": "Credit First Term",
    "first_term_noncredit": "Noncredit First Term",
}
FLOW_RIGHT = {
    "ever_credit_esl": "Ever Credit ESL",
    "always_noncredit_esl": "Always Noncredit ESL",
}
COHORT_FLAGS = (
    "first_term_noncredit", "first_term_credit", "incorrect_first_term", "ever_credit_esl",
    "always_noncredit_esl", "six_terms_attended", "twelve_terms_attended",
)
