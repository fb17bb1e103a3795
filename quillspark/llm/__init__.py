"""Operators for preparing training data. Nothing else in the library imports them."""

from importlib import import_module

_MODULES = (
    "exact_dedup",
    "language_id",
    "html_extract",
    "near_dedup",
    "substring_dedup",
    "token_output",
    "toxicity",
    "packing",
    "warc",
    "decontaminate",
    "vector_codes",
    "collocations",
    "fingerprints",
)


def _each(what: str) -> dict:
    found: dict = {}
    for name in _MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), what)
    return found


def queries() -> dict:
    """The query of each operator by its registered name."""
    return _each("QUERIES")


def oracles() -> dict:
    """SQL for those that SQL can express."""
    return _each("ORACLES")


def release(spark) -> None:
    """Remove the scratch tables and files of all results so far; call it when they have been written elsewhere, as results are read from them."""
    from ._shared import delete, made

    delete(spark, *made())
