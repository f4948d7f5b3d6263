"""plumbline: declarative data-quality checks over Spark DataFrames.

A rule names a dataset, an expectation and JSON arguments.  Rules compile to
Catalyst expressions; all rules of a dataset are evaluated in as few
distributed passes as possible, and failing rows are captured with one
partitioned write.
"""

from plumbline.operators import check, failing
from plumbline.plans.evaluate import evaluate, failing_rows
from plumbline.plans.project import run_project
from plumbline.plans.runner import DatasetRun, run_dataset
from plumbline.rule import Rule
from plumbline.session import build_session
from plumbline.sources.datasets import Dataset, Scope
from plumbline.sources.store import Store

__all__ = [
    "Dataset",
    "DatasetRun",
    "Rule",
    "Scope",
    "Store",
    "build_session",
    "check",
    "evaluate",
    "failing",
    "failing_rows",
    "run_dataset",
    "run_project",
]
