"""Hand-made raw tables."""

from __future__ import annotations

from termtrail import fixed_values as fv
from termtrail.sources.tables import RAW_SCHEMAS, TABLE_NAMES, RawTables

COLLEGES = [("141", "COMPTON"), ("271", "DIABLO VALLEY"), ("9001", "L.A. CITY"),
            ("9002", "MERRITT"), ("9003", "SOMEWHERE ELSE")]
LEVELS = [(c, i + 1) for i, c in enumerate(fv.LEVEL_LETTERS)] + [("Y", 9)]
NAMES = {1: "WINTER INTERSESSION", 3: "SPRING SEMESTER", 5: "SUMMER TERM", 7: "FALL SEMESTER",
         0: "ANNUAL"}
TERMS = [(yy * 10 + d, f"20{yy - (d in (1, 3))}-20{yy + 1 - (d in (1, 3))}", NAMES[d],
          (d + 1) // 2 if d else None) for yy in range(17, 24) for d in (0, 1, 3, 5, 7)]


def enrollment(student, gi03, course, gi01="141", grade="P", sx02=fv.NOT_DROPPED, sx01="1"):
    return (f"U{student}", f"S{student}", gi01, gi03, course, sx01, sx02, grade)


def course(cb00, gi03, cb03="493084", cb04="N", cb21="C", gi01="141", cb05="Y"):
    return (gi01, gi03, cb00, "title", cb03, cb04, cb05, cb21)


def detail(student, gi03, gi01="141", sb04="F", sb06="1", sb11="30000", sb14="A",
           sb29="Y" + "N" * 20, std1="20"):
    return (f"S{student}", gi01, gi03, sb04, sb06, sb11, sb14, sb29, std1)


def tables(spark, **rows) -> RawTables:
    """RawTables from lists of tuples; lookups and terms have defaults."""
    rows.setdefault("colleges", COLLEGES)
    rows.setdefault("levels", LEVELS)
    rows.setdefault("terms", TERMS)
    ids = sorted({r[0] for r in rows.get("enrollments", [])})
    rows.setdefault("students", [("S" + u[1:], u) for u in ids])
    rows.setdefault("head", [("S" + u[1:], 999) for u in ids])
    rows.setdefault("basic", [("S" + u[1:], None) for u in ids])
    return RawTables(**{n: spark.createDataFrame(rows.get(n, []), RAW_SCHEMAS[n])
                        for n in TABLE_NAMES})


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
