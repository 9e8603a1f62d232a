"""Operators for training-data pipelines. Nothing else in the package imports this one.

``queries()`` and ``oracles()`` gather what the modules register.
"""

from importlib import import_module

MODULES = ("sharding", "media", "packing", "lm_scoring", "simhash", "pii", "toxicity", "licences", "quality", "bpe", "filter_audit", "hyperminhash", "alignment")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__name__}.{module}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict[str, str]:
    return _gather("ORACLES")
