"""Registered queries: every operator over the given tables, with its SQL counterpart."""

from importlib import import_module

MODULES = (
    "raster_queries",
    "search_queries",
    "change_queries",
    "spectral_queries",
    "ledger_queries",
    "discovery_queries",
)


def all_queries():
    """The full registry; importing a module registers its queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry").REGISTRY
