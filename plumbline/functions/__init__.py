from plumbline.functions.arithmetic import between_a, between_b, fraction, literal, mostly_at_least, mostly_at_most
from plumbline.functions.columns import as_double, blank, false_if_null, find_column, ignore_rows, quoted
from plumbline.functions.matching import full_match, members

__all__ = [
    "as_double",
    "between_a",
    "between_b",
    "blank",
    "false_if_null",
    "find_column",
    "fraction",
    "full_match",
    "ignore_rows",
    "literal",
    "members",
    "mostly_at_least",
    "mostly_at_most",
    "quoted",
]
