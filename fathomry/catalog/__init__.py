"""All registered queries."""

import importlib

from fathomry.catalog.base import CATALOG

for _family in ("scans", "sinks", "selects", "joins", "aggregates", "windows", "shapes", "scalars", "streams", "models"):
    importlib.import_module(f"fathomry.catalog.{_family}")

__all__ = ["CATALOG"]
