"""Small sample data with planted defects, and the reconciliation samples."""

from __future__ import annotations

import datetime

DEFECT_SCHEMA = (
    "ROW_ID long, USER_ID long, STATUS string, SCORE long, CREATED_AT timestamp_ntz, EMAIL string, "
    "ISSUES string, START_VAL long, END_VAL long"
)
EARLY = datetime.datetime(2026, 2, 19, 8, 53, 51, 368000)
LATE = datetime.datetime(2026, 2, 19, 9, 4, 51, 280000)

SCORES = [85, 70, 45, 60, 92, 88, 40, 55, 77, 81] + 3 * [75, 30, 80, 82, 50, 88, 90, 35, 77, 79]
RANGES = [(10, 100), (20, 110), (30, 120), (40, 130), (50, 140), (10, 90), (15, 85), (20, 70), (25, 65), (30, 60)]
# Rows 21-30 repeat the first ten scores instead.
SCORES[20:30] = SCORES[:10]

# From row 41 on: user, status, score, email, and what else differs.
SPECIAL = [
    (101, "Active", 85, "dup@test.com", {}),
    (142, None, 50, "null@test.com", {}),
    (143, None, 50, "bad@set.com", {}),
    (144, "    ", 999, "outlier@test.com", {}),
    (145, "Active", 50, "old@test.com", {"at": datetime.datetime(2010, 1, 1)}),
    (146, "Active", 50, "invalid_email.com", {}),
    (147, "Active", 50, "short", {}),
    (148, "Active", 50, "ok@test.com", {"range": (500, 10)}),
    (149, "Active", -1, "neg@test.com", {}),
    (150, "Active", 10, "low@test.com", {}),
    (151, "Active", 70, "user; DROP TABLE users;--@test.com", {}),
    (152, "Active' OR '1'='1", 70, "sql@test.com", {}),
    (153, "Active", 2147483647, "max_int@test.com", {}),
    (154, "Active", -2147483648, "min_int@test.com", {}),
    (155, "Active", 0, "zero@test.com", {"range": (0, 0)}),
    (156, "Active", 70, "   leading_space@test.com", {}),
    (157, "Active", 70, "tab\t@test.com", {}),
    (158, "Active", 70, "a@b.c", {}),
    (159, "Active", 70, "longaaaaaaaaaaaaaaa", {}),
    (160, "Active", 70, "future@test.com", {"at": datetime.datetime(9999, 12, 31, 23, 59, 59)}),
    (161, "Active", 70, "past@test.com", {"at": datetime.datetime(1900, 1, 1)}),
    (162, "Active", 70, "equal_values@test.com", {"range": (50, 50)}),
    (163, "Active", None, "null_score@test.com", {}),
    (164, "active", 70, "lowercase@test.com", {}),
    (165, " ACTIVE ", 70, "padded@test.com", {}),
    (166, "Active", 70, "triple1@test.com", {}),
    (166, "Active", 70, "triple2@test.com", {}),
    (166, "Active", 70, "triple3@test.com", {}),
    (169, "Active", 70, "no_tld@test", {}),
    (170, "Active", 70, "double@@test.com", {}),
    (171, "Active", 70, "..dot@test.com", {}),
    (172, "Active", 70, "email@sub.sub.sub.com", {}),
    (173, "Active", 1000000, "high_skew@test.com", {}),
    (174, "Active", 1000000, "high_skew2@test.com", {}),
    (175, "Active", 70, "normal_end@test.com", {}),
]


def defect_rows() -> list[tuple]:
    rows = []
    for i, score in enumerate(SCORES, start=1):
        status = "Inactive" if score in (45, 40, 30, 35) else "Pending" if score in (60, 55, 50) else "Active"
        email = None if i == 4 else f"user{i}@test.com" if i <= 10 else f"u{i}@t.com"
        low, high = RANGES[i - 1] if i <= 10 else (10, 50)
        rows.append((i, 100 + i, status, score, EARLY, email, None, low, high))
    for i, (user, status, score, email, other) in enumerate(SPECIAL, start=41):
        at = other.get("at", EARLY if i <= 50 else LATE)
        low, high = other.get("range", (10, 50))
        rows.append((i, user, status, score, at, email, None, low, high))
    return rows


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def at(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text)


CORE_SCHEMA = "CUSTOMER_ID long, INSERT_DATE_TIME timestamp_ntz"
CORE = [
    (101, at("2025-01-24 11:10:05")),
    (102, at("2025-01-24 11:10:06")),
    (103, at("2025-01-24 11:10:07")),
    (104, at("2025-01-24 11:11:05")),
    (105, at("2025-01-24 11:12:05")),
]
HISTORY_SCHEMA = (
    "CUSTOMER_SK long, CUSTOMER_ID long, IS_ACTIVE string, INSERT_DATE_TIME timestamp_ntz, "
    "UPDATE_DATE_TIME timestamp_ntz"
)
LOADED = at("2025-01-24 14:15:00")
HISTORY = [(i, 100 + i, "N", at("2024-06-01 14:30:00"), LOADED) for i in (1, 2, 3)] + [
    (i, 97 + i, "Y", LOADED, LOADED) for i in (4, 5, 6, 7, 8)
]
SECOND = at("2025-02-01 14:30:00")
CORE_1 = CORE + [(c, at(f"2025-02-01 10:10:0{s}")) for c, s in ((104, 2), (106, 3), (107, 4))]
HISTORY_1 = [
    (sk, c, "N", i, SECOND) if (c, a) == (104, "Y") else (sk, c, a, i, u) for sk, c, a, i, u in HISTORY
] + [(9, 104, "Y", SECOND, SECOND), (10, 106, "Y", SECOND, SECOND), (11, 107, "Y", SECOND, SECOND)]
CORE_2 = CORE_1 + [(108, at("2025-02-15 09:45:01")), (109, at("2025-02-15 09:45:02"))]
THIRD = at("2025-03-01 14:00:00")
HISTORY_3 = [
    (sk, c, "N", i, THIRD) if (c, a) == (105, "Y") else (sk, c, a, i, u) for sk, c, a, i, u in HISTORY
] + [(12, 105, "Y", THIRD, THIRD)]

AUDIT_SCHEMA = (
    "TARGET_TABLE string, NUMBER_OF_RECORDS_SOURCE long, NUMBER_OF_RECORDS_TARGET long, SYNC_LEVEL string, "
    "SYNC_STATUS string, SYNC_START_DATE_TIME timestamp_ntz"
)
AUDIT = [
    ("SALES.PUBLIC.ORDERS_CORE", 10, 10, "SOURCE_TO_CORE", "Success", at("2025-01-24 10:15:00")),
    ("SALES.PUBLIC.CUSTOMERS_CORE", 5, 5, "SOURCE_TO_CORE", "Success", at("2025-01-24 11:10:00")),
    ("SALES.PUBLIC.VCRM_USER_C", 0, 0, "SOURCE_TO_CORE", "Success", at("2025-01-24 13:00:00")),
    ("SALES.PUBLIC.ORDERS_CORE", 10, 0, "SOURCE_TO_CORE", "Failure", at("2025-01-20 09:00:00")),
    ("SALES.PUBLIC.ORDERS_CORE", 10, 10, "SOURCE_TO_CORE", "Success", at("2025-01-20 09:15:00")),
]
