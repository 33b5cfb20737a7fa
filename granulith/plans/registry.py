"""Registry of the runnable queries and the SQL each is checked against."""

from functools import lru_cache

from granulith.fixtures import ORACLE_CTES, Workbench

QUERIES = {}
ORACLES = {}


@lru_cache(maxsize=4)
def _workbench(spark, sf_dir: str) -> Workbench:
    """Queries of one session share the lazy table definitions (plans, not data)."""
    return Workbench(spark, sf_dir)


def query(name: str, oracle: str | None = None):
    """Register `fn(workbench) -> DataFrame`; `oracle` continues the shared table expressions."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir):
            return fn(_workbench(spark, str(sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            # some statements walk a log step by step
            head = ORACLE_CTES.replace("with images", "with recursive images", 1) if "recursive" in oracle else ORACLE_CTES
            ORACLES[name] = head + oracle.replace("/*recursive*/", "")
        return fn
    return register
