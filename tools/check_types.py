"""Compares the column types of registered queries and their SQL: check_types.py SF_DIR"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from check_queries import connect  # noqa: E402

SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def mismatches(df, con, sql: str) -> list[tuple[str, str, str]]:
    duck = {name: kind for name, kind, *_ in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [(n, t, duck.get(n, "absent")) for n, t in df.dtypes if SAME.get(t) != duck.get(n)]


def main() -> int:
    from deckloom.plans import CHECKS, QUERIES
    from deckloom.session import local_session

    spark, con, bad = local_session(), connect(sys.argv[1]), 0
    for name, sql in CHECKS.items():
        found = mismatches(QUERIES[name](spark, sys.argv[1]), con, sql)
        if found:
            bad += 1
            print(name, found, flush=True)
    print("queries with other types:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
