"""Registered queries over the given tables; importing the package fills the registry."""

import importlib
import pkgutil

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
    importlib.import_module(f"{__name__}.{_module}")
