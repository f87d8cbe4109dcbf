"""Run one registered query and print its rows (and optionally its plan).

    python scripts/run_query.py NAME [sf_dir] [--explain]
    python scripts/run_query.py --list
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from growthlens.plans.registry import QUERIES  # noqa: E402
from growthlens.session import local_session  # noqa: E402


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    if "--list" in sys.argv or not args:
        print("\n".join(QUERIES))
        return
    name = args[0]
    sf_dir = args[1] if len(args) > 1 else "/root/testdata/sf0.01"
    df = QUERIES[name](local_session(), sf_dir)
    if "--explain" in sys.argv:
        df.explain("formatted")
    df.show(100, truncate=False)


if __name__ == "__main__":
    main()
