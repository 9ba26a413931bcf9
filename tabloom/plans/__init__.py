"""The registered queries: importing this package fills the registry."""

from importlib import import_module

MODULES = ["questions", "profiles", "cleaning", "sources", "temporal", "audits", "evaluations", "insights", "structure", "texts", "graphs", "learning"]

for _name in MODULES:
    import_module(f"{__name__}.{_name}")
