"""What a task process keeps from one task to the next: loaded models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle

_kept: dict[str, Any] = {}


def key_of(thing) -> str:
    """Names a provider, counter or embedder by its content; taken on the driver."""
    return hashlib.sha256(cloudpickle.dumps(thing)).hexdigest()


def kept(key: str, load: Callable[[], Any]):
    """``load()``, called once per process for a key."""
    if key not in _kept:
        _kept[key] = load()
    return _kept[key]
