"""All queries of the core library."""

from __future__ import annotations

from foliospark.plans import assembly, captures, declared, jobs, pages, qualities, retrieval, smaller, store, timelines
from foliospark.plans.registry import Registry

MODULES = (captures, retrieval, timelines, store, qualities, pages, jobs, assembly, declared, smaller)


def catalog() -> Registry:
    """A registry with every query of the core."""
    registry = Registry()
    for module in MODULES:
        module.register(registry)
    return registry
