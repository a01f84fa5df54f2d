"""Names that a later version drops."""

from __future__ import annotations

import functools
import os
import warnings
from collections.abc import Callable
from typing import TypeVar

import derivia.plans

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(derivia.plans.__file__)))
Called = TypeVar("Called", bound=Callable)


class DeriviaDeprecationWarning(DeprecationWarning):
    """A name or option that a later version drops: since which one it is discouraged, and which one is to drop it."""

    def __init__(self, message: str = "", since: str = "", expected_removal: str = ""):
        super().__init__(message, since, expected_removal)
        self.message, self.since, self.expected_removal = message, since, expected_removal

    def __str__(self) -> str:
        return self.message


def warn_deprecated(what: str, since: str, expected_removal: str, instead: str = "") -> None:
    """Warn of a name, at the line outside this package from which it was reached."""
    message = f"{what} is deprecated since {since} and will go in {expected_removal}" + (f"; use {instead}" if instead else "")
    warnings.warn(DeriviaDeprecationWarning(message, since, expected_removal), skip_file_prefixes=(_PACKAGE,))


def deprecated(since: str, expected_removal: str, instead: str = "") -> Callable[[Called], Called]:
    """Decorator of a function that warns at each call."""

    def wrap(f: Called) -> Called:
        @functools.wraps(f)
        def call(*args, **kwargs):
            warn_deprecated(f"{f.__qualname__}()", since, expected_removal, instead)
            return f(*args, **kwargs)

        return call

    return wrap
