"""Query registrations by area. Importing a module registers its queries."""

from importlib import import_module

AREAS = ("demand", "grids", "boundaries", "features", "trajectories", "events", "runs", "models", "sources", "synthesis")


def load() -> None:
    for area in AREAS:
        import_module(f"{__name__}.{area}")
