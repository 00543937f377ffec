"""Study parameters: every window, code list and threshold an operator uses."""

from __future__ import annotations

from dataclasses import dataclass

from termtrail import fixed_values as fv


@dataclass(frozen=True)
class StudyParams:
    """Inclusive term-code windows and code lists. The windows differ on purpose."""

    profile_window: tuple[int, int] = (175, 234)      # citizenship, education, highest degree
    sequence_window: tuple[int, int] = (175, 299)     # per-term sequences
    first_level_window: tuple[int, int] = (175, 269)  # raw first level
    completion_window: tuple[int, int] = (175, 300)   # adjusted first level, completion
    entry_window: tuple[int, int] = (175, 234)        # first enrollment of the study sample
    first_esl_window: tuple[int, int] = (175, 264)    # first ESL term of the study sample
    observe_six_window: tuple[int, int] = (175, 251)
    observe_twelve_window: tuple[int, int] = (175, 235)
    award_from: int = 175
    noncredit_from: int = 175
    # century wrap of term codes: small = 2000s, large = 1900s
    enrollment_wrap: tuple[int, int, int] = (700, 300, 999)   # cut, then range of the 1900s
    esl_wrap: tuple[int, int, int] = (270, 270, 999)
    esl_programs: tuple[str, ...] = fv.ESL_PROGRAMS
    withdrawn: tuple[str, ...] = fv.WITHDRAWN_GRADES
    not_passed: tuple[str, ...] = fv.NOT_PASSED_GRADES
    not_dropped: str = fv.NOT_DROPPED


@dataclass(frozen=True)
class DisclosureParams:
    min_cell: int = fv.MIN_CELL
    cohorts: tuple[str, ...] = fv.ENTRY_COHORTS
    censored_cohort: str = fv.CENSORED_COHORT
    groups: tuple[str, ...] = (fv.GROUP_NONCREDIT, fv.GROUP_CREDIT)
    term_cap: int = 10
    complementary: bool = False   # also blank what would give small counts away


STUDY = StudyParams()
DISCLOSURE = DisclosureParams()
