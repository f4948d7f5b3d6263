from plumbline.sources.datasets import Dataset, Scope
from plumbline.sources.store import Store

__all__ = ["Dataset", "Scope", "Store"]
