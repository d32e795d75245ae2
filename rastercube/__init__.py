"""A PySpark-native engine for catalogs of imagery: items, schemas, grids, and cubes of pixels."""

from __future__ import annotations

import importlib

#: What is offered at the top, and where it lives; modules are imported when they are asked for.
_PUBLIC = {
    "load": "plans.cube",
    "LoadPlan": "plans.cube",
    "output_grid": "plans.cube",
    "chunk_shape": "plans.cube",
    "Grid": "operators.grids",
    "Collections": "operators.infer",
    "MDConfig": "operators.infer",
    "collections_of": "operators.infer",
    "parse_items": "operators.infer",
    "extract_collection_metadata": "operators.infer",
    "parse_documents": "sources.stac",
    "items_table": "sources.stac",
    "assets_table": "sources.stac",
    "search": "sources.stac",
    "s3_settings": "sources.settings",
    "register_reader": "sources.settings",
    "products": "plans.products",
    "infer_product": "plans.products",
    "datasets": "plans.products",
}
#: Other names of the same.
_ALIASES = {"stac_load": "load", "output_geobox": "output_grid", "infer_dc_product": "infer_product", "stac2ds": "datasets", "configure_s3_access": "s3_settings"}

__all__ = [*_PUBLIC, *_ALIASES]


def __getattr__(name: str):
    name = _ALIASES.get(name, name)
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_PUBLIC[name]}"), name)


def __dir__():
    return sorted(__all__)
