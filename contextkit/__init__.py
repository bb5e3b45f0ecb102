"""contextkit: text-context operators on PySpark DataFrames.

Functions of this package travel to the executors by value, so a cluster
needs no copy of it on its Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from contextkit.operators.chunk import MarkdownChunker  # noqa: E402
from contextkit.operators.pack import ContextPacker  # noqa: E402
from contextkit.sources.cache import FuzzyCache  # noqa: E402

__all__ = ["ContextPacker", "FuzzyCache", "MarkdownChunker", "hello_world"]


def hello_world() -> str:
    return "Hello from contextkit!"
