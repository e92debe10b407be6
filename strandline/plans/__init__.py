"""Named queries over the test tables, each beside its SQL."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Import every module of queries, which register themselves."""
    for module in iter_modules(__path__):
        if module.name.startswith("q_"):
            import_module(f"{__name__}.{module.name}")
