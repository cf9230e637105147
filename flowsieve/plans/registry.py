"""All registered queries, gathered from the ``q_*`` modules of this package.

Each module has ``QUERIES``: name → (function of session and folder, SQL text or None).
"""

from __future__ import annotations

import importlib
import pkgutil

from flowsieve import plans
from flowsieve.session import require_utc


def _all() -> dict:
    found: dict = {}
    for info in pkgutil.iter_modules(plans.__path__):
        if info.name.startswith("q_"):
            found.update(importlib.import_module(f"{plans.__name__}.{info.name}").QUERIES)
    return dict(sorted(found.items()))


def names() -> list[str]:
    return list(_all())


def runner(name: str):
    function = _all()[name][0]

    def run(spark, sf_dir):
        require_utc(spark)
        return function(spark, sf_dir)

    run.__name__ = name
    return run


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
