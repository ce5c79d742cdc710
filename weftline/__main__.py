"""python -m weftline QUERY FOLDER [OUTPUT]: runs a library query over the tables of a folder; without QUERY, lists them."""

from __future__ import annotations

import sys

from weftline.queries import QUERIES
from weftline.session import session


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if not args:
        print("\n".join(sorted(QUERIES)))
        return 0
    if len(args) not in (2, 3) or args[0] not in QUERIES:
        print(__doc__, file=sys.stderr)
        return 2
    rows = QUERIES[args[0]](session(), args[1])
    if len(args) == 3:
        rows.write.parquet(args[2])
    else:
        rows.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
