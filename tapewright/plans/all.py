"""The registries of the library itself."""

from __future__ import annotations

import importlib

from tapewright.plans.registry import Registry

MODULES = ["tapewright.plans.quality", "tapewright.plans.market", "tapewright.plans.research", "tapewright.plans.desk"]


def registries() -> list[Registry]:
    return [importlib.import_module(m).REGISTRY for m in MODULES]
