"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from albumen.operators.graph import connected_components, local_components, materialise, release, shared_dir

__all__ = ["connected_components", "forget", "kept", "local_components", "materialise", "new_path", "release", "shared_dir"]

#: What a Python worker keeps from task to task: one thing, so that the caches of several operators never add up.
_KEPT: dict[tuple[str, str], object] = {}


def kept(kind: str, key: str, make: Callable[[], object]):
    """The worker's object of this kind and key; what it kept before for another one is dropped."""
    if (kind, key) not in _KEPT:
        _KEPT.clear()
        _KEPT[kind, key] = make()
    return _KEPT[kind, key]


def forget() -> None:
    """Drops what the worker keeps, at the end of a task whose cache is not worth its memory to later ones."""
    _KEPT.clear()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
