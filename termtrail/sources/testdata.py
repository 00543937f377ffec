"""Raw tables derived from the driver's test tables.

One enrollment per (line item, order, part): every row of the three tables is
used. Orders a fixture rule calls "not attended" stay in as dropped
enrollments, so the drop filter of the library is what removes them.
"""

from __future__ import annotations

from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail import fixed_values as fv
from termtrail.functions import sequences as seq
from termtrail.sources.store import TableStore
from termtrail.sources.tables import schema

DRIVER_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
                "l_discount double, l_tax double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
    "customer": "c_custkey bigint, c_acctbal double",
    "events": "user_id bigint, event_type string",
}

# --- fixed values of the fixture ------------------------------------------
COLLEGE_NAMES = (fv.COLLEGES_AB + fv.COLLEGES_EF + fv.COLLEGES_SIX + fv.COLLEGES_POSSIBLE
                 + tuple(f"OTHER COLLEGE {i}" for i in range(10)))
LISTED_CODES = fv.COLLEGE_CODES_AB + fv.COLLEGE_CODES_EF
PROGRAM_BY_TYPE = {"ECONOMY": "493084", "SMALL": "493085", "MEDIUM": "493086",
                   "LARGE": "493087", "PROMO": "150100", "STANDARD": "170000"}
AWARD_CODES = "ASTEFGHJKUZ"
GRADES = ("W", "F", "NP", "P")
GOAL_CODES = "ABCEFGHJKLMNOX"
TOPCODES = (493084, 493087, 493100, 493009, 493062, 490100, 499900, 70100)
TERM_NAMES = {0: "ANNUAL", 1: "WINTER INTERSESSION", 3: "SPRING SEMESTER", 5: "SUMMER TERM",
              7: "FALL SEMESTER"}
LEVEL_OF = {**{c: i + 1 for i, c in enumerate(fv.LEVEL_LETTERS)}, fv.UNSPECIFIED_LEVEL: 9}


def college_code(index: int) -> str:
    return LISTED_CODES[index] if index < len(LISTED_CODES) else f"9{index:03d}"


def open_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(text: str, index: Column) -> Column:
    return F.substr(F.lit(text), (index + 1).cast("int"), F.lit(1))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)).cast("bigint")


def _course_id() -> Column:
    return F.concat_ws("-", "pk", "cb04", "cb21")


def _college(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(college_code(i)) for i in range(92)]), (index + 1).cast("int"))


def _character(number: Column) -> Column:
    """The character of ``F.ascii``, of any code point; nothing is 0."""
    return F.when(number == 0, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def _order_columns(orders: DataFrame) -> DataFrame:
    c = F.col("o_custkey")
    year = F.year("o_orderdate")
    q = F.quarter("o_orderdate")
    shifted = (year + 22) % 100
    yy = (F.when(c % 149 == 0, year - 1905)
          .when((F.col("o_orderkey") % 397 == 0) & (year < 2000), year % 100)
          .otherwise(shifted))
    return orders.select(
        "o_orderkey", c.alias("c"), (year + 22).alias("y"),
        (yy * 10 + q * 2 - 1).cast("int").alias("gi03"),
        F.left("o_orderpriority", F.lit(1)).alias("priority"), "o_orderstatus", "o_orderdate")


def enrollment_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order and part, as enrollment and course attributes.

    Ids that a projection of these columns gives are not written.
    """
    li = open_driver_table(spark, sf_dir, "lineitem")
    orders = _order_columns(open_driver_table(spark, sf_dir, "orders"))
    part = open_driver_table(spark, sf_dir, "part")
    c, line, y = F.col("c"), F.col("l_linenumber"), F.col("y")
    size, pk = F.col("p_size"), F.col("p_partkey")
    brand = F.substring("p_brand", 7, 2).cast("int")
    college = F.when(line == 7, (c * 7 + 3) % 92).otherwise((c * 13) % 92)
    d = F.when(pk % 2 == 0, "C").otherwise("D")
    credit = (F.when(c % 10 < 5, "N").when(c % 10 < 8, d)
              .otherwise(F.when(size <= 25, "N").otherwise("C")))
    level_at = _div(c, 10) % 9 + brand % 3 - 1 - F.floor((y - 2017) / 2)
    level = F.when(brand == 25, "Y").otherwise(
        _pick("ABCDEFGH", F.greatest(F.lit(0), F.least(F.lit(7), level_at))))
    attended = ((F.col("o_orderkey") % 5 < 1 + c % 5)
                & ((F.col("o_orderkey") + line) % 3 != 0) & F.col("cheap"))
    # what a line or a part decides is worked out before it is shuffled: grades as their numbers
    grade = (F.when((F.col("l_quantity") == 50) & (line == 3), F.lit(None))
             .when(F.col("l_quantity") < 3, 1).when(F.col("l_quantity") < 5, 2)
             .when(F.col("l_quantity") < 6, 3).otherwise(4))
    li = li.select("l_orderkey", "l_partkey", "l_linenumber", grade.cast("tinyint").alias("grade"),
                   (F.col("l_discount") < 0.095).alias("cheap"), (F.col("l_tax") > 0).alias("taxed"))
    ordered = li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        "l_partkey", "l_linenumber", "grade", "taxed", attended.alias("attended"), "c", "y", "gi03", "priority")
    joined = ordered.join(part, ordered.l_partkey == part.p_partkey)
    return joined.select(
        "c", "y", "gi03", "priority", college.alias("college"), pk.alias("pk"),
        F.coalesce(*[F.when(F.col("p_type") == t, p) for t, p in PROGRAM_BY_TYPE.items()])
        .alias("cb03"),
        credit.alias("cb04"), level.alias("cb21"),
        F.when((college % 4 == 0) | (pk % 3 == 2), "Y").when(pk % 3 == 0, "A").otherwise("B")
        .alias("cb05"),
        F.when(F.col("taxed"), line.cast("string")).alias("sx01"),
        F.when(F.col("attended"), fv.NOT_DROPPED).otherwise("20190101").alias("sx02"),
        F.get(F.array(*map(F.lit, GRADES)), F.col("grade") - 1).alias("sx04"))


def _details(base: DataFrame) -> DataFrame:
    c = F.col("c")
    # the one character as its number: a string buffer would sort every row
    terms = base.groupBy("c", "college", "gi03", "y").agg(F.min(F.ascii("priority")).alias("p")).withColumns({
        "gi01": _college(F.col("college")), "p": _character(F.col("p"))})
    bit = c % 11
    at = lambda *spots: F.lit("".join("Y" if i in spots else "N" for i in range(1, 22)))
    bits = (F.when(bit == 0, F.lit(None)).when(bit == 1, "NNN").when(bit == 2, at())
            .when(bit == 3, at(1, 2)).when(bit == 4, at(5)).when(bit == 5, at(14))
            .when(bit == 6, at(17, 21)).when(bit == 7, at(15)).when(bit == 8, at(16, 15))
            .when(bit == 9, at(21)).otherwise(at(1, 3, 21)))
    return terms.select(
        F.concat(F.lit("S"), c).alias("maskedsb00"), "gi01", "gi03",
        F.when(c % 7 < 3, "F").when(c % 7 < 5, "M").when(c % 7 == 5, "X").alias("sb04"),
        F.when(F.col("p") == "5", "X").otherwise(F.col("p")).alias("sb06"),
        F.when(c % 10 == 9, "X0000").otherwise(F.concat((c % 10).cast("string"), F.lit("0000")))
        .alias("sb11"),
        _pick(GOAL_CODES, (c + F.col("college")) % 14).alias("sb14"), bits.alias("sb29"),
        (16 + c % 60 + F.col("y") - 2017).cast("string").alias("std1"))


def _courses(base: DataFrame) -> DataFrame:
    """The distinct offerings. Part, term, college and codes decide all columns, so only they are
    shuffled: the part, the term, and all others in one number, a digit for each (0: null).
    """
    digits = {"college": tuple(range(92)), "cb03": tuple(PROGRAM_BY_TYPE.values()), "cb04": ("N", "C", "D"),
              "cb05": ("Y", "A", "B"), "cb21": tuple("ABCDEFGHY")}
    number = F.lit(0)
    for c, values in digits.items():
        at = F.array_position(F.array(*map(F.lit, values)), F.col(c)) if c != "college" else F.col(c) + 1
        number = number * (len(values) + 1) + F.coalesce(at, F.lit(0)).cast("int")
    rest, columns = F.col("rest"), {}
    for c, values in reversed(digits.items()):
        columns[c] = F.get(F.array(F.lit(None), *map(F.lit, values)), rest % (len(values) + 1)).alias(c)
        rest = F.floor(rest / (len(values) + 1)).cast("int")
    out = base.select("pk", "gi03", number.alias("rest")).distinct().select("pk", "gi03", *columns.values())
    return out.select(_college(F.col("college")).alias("gi01"), "gi03", _course_id().alias("cb00"),
                      F.concat(F.lit("ESL "), F.col("pk")).alias("cb01"), "cb03", "cb04", "cb05", "cb21")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = (_order_columns(open_driver_table(spark, sf_dir, "orders"))
            .select("gi03").distinct())
    codes = seen.union(seen.select((F.col("gi03") - F.col("gi03") % 10))).distinct()
    digit, yy = F.col("gi03") % 10, _div(F.col("gi03"), 10).cast("int")
    start = yy + F.when(F.col("gi03") < 270, 2000).otherwise(1900) - F.when(
        digit.isin(1, 3), 1).otherwise(0)
    name = F.coalesce(*[F.when(digit == d, n) for d, n in TERM_NAMES.items()])
    return codes.select(
        "gi03", F.concat_ws("-", start, start + 1).alias("year"), name.alias("term"),
        F.when(digit > 0, _div(digit + 1, 2)).cast("int").alias("quarter"))


def _awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is an award row; those not awarded have no date."""
    o = _order_columns(open_driver_table(spark, sf_dir, "orders"))
    awarded = (F.col("priority") == "1") & (F.col("o_orderstatus") == "F")
    c, key = F.col("c"), F.col("o_orderkey")
    when = F.col("o_orderdate")
    day = F.least(F.day(when), F.lit(28))
    top = F.array(*[F.lit(t) for t in TOPCODES])
    return o.select(
        F.concat(F.lit("S"), c).alias("maskedsb00"), F.concat(F.lit("U"), c).alias("student_uuid"),
        F.when(key % 23 != 0, F.element_at(top, (key % len(TOPCODES) + 1).cast("int")))
        .alias("sp01"),
        _pick(AWARD_CODES, key % len(AWARD_CODES)).alias("sp02"),
        F.when(awarded & (key % 29 != 0), F.col("y") * 10000 + F.month(when) * 100 + day).cast("int")
        .alias("sp03"), "gi03")


def _lookup(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """A small fixed lookup as a local relation, whose size Spark knows."""
    ddl = schema(name)
    columns = {f.name: pa.array([r[i] for r in rows],
                                pa.int32() if f.dataType.typeName() == "integer" else pa.string())
               for i, f in enumerate(ddl.fields)}
    return spark.createDataFrame(pa.table(columns))


class DriverTables:
    """The raw tables of the library, derived from one driver test folder.

    With a store, tables that need a shuffle are written on first use and read
    back, so queries start from raw tables as they would in a warehouse. Tables
    that are a projection or filter of a file stay one.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, store: TableStore | None = None):
        self._spark, self._dir, self._store = spark, sf_dir, store

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        return self._store.table(name, df) if self._store else df

    def _open(self, name: str) -> DataFrame:
        return open_driver_table(self._spark, self._dir, name)

    @cached_property
    def _base(self) -> DataFrame:
        return self._keep("enrollment_base", enrollment_base(self._spark, self._dir))

    @cached_property
    def _first_seen(self) -> DataFrame:
        return self._keep("first_seen", _order_columns(self._open("orders")).groupBy("c").agg(
            F.min("gi03").alias("first")))

    @cached_property
    def students(self) -> DataFrame:
        c = F.col("c_custkey")
        return self._open("customer").select(
            F.concat(F.lit("S"), c).alias("maskedsb00"), F.concat(F.lit("U"), c).alias("uuid"))

    @cached_property
    def details(self) -> DataFrame:
        return self._keep("details", _details(self._base))

    @cached_property
    def disability(self) -> DataFrame:
        c = F.col("c_custkey")
        recorded = F.col("c_acctbal") < 0
        return self._open("customer").select(
            F.concat(F.lit("S"), c).alias("maskedsb00"),
            F.when(recorded & (c % 2 == 0), "M").when(recorded, "P").alias("sd01"))

    @cached_property
    def aid(self) -> DataFrame:
        user, kind = F.col("user_id"), F.col("event_type")
        return self._open("events").select(
            F.concat(F.lit("S"), user).alias("maskedsb00"),
            F.when((kind == "purchase") & (user % 2 == 0), "GP")
            .when((kind == "signup") & (user % 3 == 0), "GE").otherwise("XX").alias("sf21"))

    @cached_property
    def head(self) -> DataFrame:
        c = F.col("c")
        return self._first_seen.select(
            F.concat(F.lit("S"), c).alias("maskedsb00"),
            (F.col("first") - F.when(c % 13 == 0, 10).otherwise(0)).alias("ccc_first_term"))

    @cached_property
    def basic(self) -> DataFrame:
        c = F.col("c")
        return self._first_seen.select(
            F.concat(F.lit("S"), c).alias("maskedsb00"),
            F.when(c % 17 != 0, F.col("first")).alias("scd1"))

    @cached_property
    def awards(self) -> DataFrame:
        return _awards(self._spark, self._dir)

    @cached_property
    def enrollments(self) -> DataFrame:
        c = F.col("c")
        return self._base.select(
            F.concat(F.lit("U"), c).alias("student_uuid"), F.concat(F.lit("S"), c).alias("maskedsb00"),
            _college(F.col("college")).alias("gi01"), "gi03", _course_id().alias("cb00"), "sx01", "sx02", "sx04")

    @cached_property
    def courses(self) -> DataFrame:
        return self._keep("courses", _courses(self._base))

    @cached_property
    def terms(self) -> DataFrame:
        return self._keep("terms", _terms(self._spark, self._dir))

    @cached_property
    def award_types(self) -> DataFrame:
        return _lookup(self._spark, "award_types",
                       [(c, f"Award {c}", i + 1) for i, c in enumerate(AWARD_CODES)])

    @cached_property
    def colleges(self) -> DataFrame:
        return _lookup(self._spark, "colleges",
                       [(college_code(i), n) for i, n in enumerate(COLLEGE_NAMES)])

    @cached_property
    def levels(self) -> DataFrame:
        return _lookup(self._spark, "levels", list(LEVEL_OF.items()))

    @cached_property
    def topcodes(self) -> DataFrame:
        return _lookup(self._spark, "topcodes", [(t, f"Subject {t}") for t in TOPCODES])


def _number(column: str) -> Column:
    return F.substring(F.col(column), 2, 20).cast("bigint")


def dashboard_people(flat: DataFrame) -> DataFrame:
    """The exploration table: a text projection of all students with dirty values."""
    c = _number("uuid")
    levels = seq.level_numbers(F.col("lowest_cb21_level_adjusted_all_credit_types_by_terms"))
    yes_no = lambda n: F.when(F.col(n), F.when(c % 8 == 0, "y ").otherwise("Y")).when(~F.col(n), "N")
    score = lambda k: F.concat(F.lit("A"), (k % 6 + 1).cast("string"))
    races = ("latin_american", "aapi", "black", "indigenous_american", "white", "no_data")
    return flat.select(
        "uuid", F.concat(F.lit("9"), F.lpad((c % 1000).cast("string"), 4, "0")).alias("zip_code"),
        (c % 3).cast("string").alias("residence_aggregated"),
        F.col("first_term_enrolled").cast("string").alias("sample_first_term"),
        F.when(c % 13 == 0, "").when(c % 11 == 0, F.concat(F.lit(" "), F.lower("gender")))
        .otherwise(F.col("gender")).alias("gender"),
        F.when(c % 9 == 0, F.lit(None)).when(c % 9 == 1, "X")
        .otherwise(yes_no("hispanic_non_hispanic")).alias("hispanic_non_hispanic"),
        *[yes_no(r).alias(r) for r in races],
        F.when(F.col("english_or_math_enrollment"), "TRUE")
        .when(~F.col("english_or_math_enrollment"), "no").alias("english_or_math_enrollment"),
        F.col("special_admit_dual_enrollment").cast("int").cast("string")
        .alias("special_admit_dual_enrollment"),
        F.when(c % 4 == 0, "YES").when(c % 4 == 1, "N").when(c % 4 == 2, "maybe")
        .alias("prior_non_success"),
        F.when(c % 31 == 0, "n/a").otherwise(F.col("age_at_first_term")).alias("age_at_first_term"),
        F.when(c % 37 == 0, " ").when(c % 41 != 0, F.col("first_college_name"))
        .alias("main_campus_name"),
        F.when(c % 19 == 0, " ").when(c % 5 != 0, score(c)).alias("earliest_efl_score"),
        F.when(c % 3 != 0, score(_div(c, 3))).alias("latest_efl_score"),
        F.try_element_at(levels, F.lit(1)).cast("string").alias("first_level"),
        F.array_max(levels).cast("string").alias("lowest_level"),
        F.when(c % 43 == 0, "unknown").otherwise(F.array_min(levels).cast("string"))
        .alias("highest_level"))


def dashboard_cohort(flat: DataFrame) -> DataFrame:
    """The cohort table: text flags as a CSV export would hold them."""
    c = _number("uuid")
    spelled = F.when(c % 3 == 0, "Y").when(c % 3 == 1, "true").otherwise(" 1 ")
    text = lambda flag: F.when(flag, spelled).when(~flag, "N")
    terms = F.length("any_esl_enrollment_by_terms")
    return flat.select(
        text(F.col("first_term_noncredit")).alias("first_term_noncredit"),
        text(F.col("first_term_credit_only")).alias("first_term_credit"),
        text(F.col("first_term_enrolled") > F.col("first_esl_term")).alias("incorrect_first_term"),
        text(F.col("ever_credit_esl")).alias("ever_credit_esl"),
        text(F.col("always_noncredit_esl")).alias("always_noncredit_esl"),
        text(terms >= 6).alias("six_terms_attended"), text(terms >= 12).alias("twelve_terms_attended"),
        F.when(c % 53 != 0, F.col("first_academic_year")).alias("first_academic_year"), "cohort")
