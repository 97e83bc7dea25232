"""The fifteen named failures of the table layer."""

from __future__ import annotations


class TableError(Exception):
    """Base of all of them."""


_NAMES = (
    "NameTypeMismatch BadSpecifiedType BadSpecifiedName NoNamesSpecified ImproperUsage MissingModule UnknownName "
    "Unsupported BadAssignment BadElement BadTarget BadValue BadIndex BadData Empty"
).split()
for _name in _NAMES:
    globals()[_name] = type(_name, (TableError,), {"__module__": __name__})
__all__ = ["TableError", *_NAMES]
