"""Column expressions spelled once per JVM.

A column over column *names* is the same in every plan. Spelling a long one
takes thousands of calls into the JVM; a plan made later can take the first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark import SparkContext


def spelled_once(build: Callable) -> Callable:
    """Remember what ``build`` returns for its (hashable) arguments in this JVM."""
    @lru_cache(maxsize=32)
    def made(_gateway, *args):
        return build(*args)

    @wraps(build)
    def get(*args):
        return made(SparkContext._gateway, *args)

    return get
