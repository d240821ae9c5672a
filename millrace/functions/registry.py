"""User functions: scalar functions over Arrow batches and registration from properties."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def scalar_function(result: DataType, deterministic: bool = True) -> Callable:
    """Decorate ``f(*series) -> series`` as a vectorised scalar function."""

    def wrap(fn: Callable[..., pd.Series]):
        made = F.pandas_udf(fn, result)
        return made if deterministic else made.asNondeterministic()

    return wrap


def from_properties(properties: Mapping[str, object]) -> object:
    """Build a function from ``{"class": "module:Name", "constructor": [...]}``.

    A constructor value may itself be such a description, so objects can be nested.
    """
    module, _, attribute = str(properties["class"]).partition(":")
    target = getattr(importlib.import_module(module), attribute)
    values = [
        from_properties(value) if isinstance(value, Mapping) else value for value in properties.get("constructor", [])
    ]
    return target(*values) if values or isinstance(target, type) else target


def register_functions(spark: SparkSession, functions: Mapping[str, object]) -> None:
    """Register functions or their property descriptions under SQL names."""
    for name, function in functions.items():
        made = from_properties(function) if isinstance(function, Mapping) else function
        if hasattr(made, "evalType") and hasattr(made, "func") and not hasattr(made, "returnType"):
            spark.udtf.register(name, made)
        else:
            spark.udf.register(name, made)
