"""Runs queries beside their SQL and compares: python tests/twins.py SF_DIR [NAME...]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame):
    """A frame's rows as sorted text, columns by name."""
    frame = frame[sorted(frame.columns)]

    def show(x):
        if isinstance(x, float):
            return "null" if x != x else repr(round(x, 6))
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or str(x) in ("NaT", "<NA>"):
            return "null"
        if isinstance(x, bool):
            return str(x)
        return repr(round(float(x), 6)) if isinstance(x, int) else str(x)

    return list(frame.columns), sorted("|".join(show(x) for x in row) for row in frame.itertuples(index=False))


def compared(spark, con, name, query, sql, sf_dir):
    """None, or what differs."""
    mine, rows = rows_of(query(spark, sf_dir).toPandas())
    theirs, expected = rows_of(con.execute(sql).df())
    if mine != theirs:
        return f"columns {mine} and {theirs}"
    if not rows:
        return "no rows"
    if rows != expected:
        odd = [(a, b) for a, b in zip(rows, expected) if a != b][:2]
        return f"{len(rows)} and {len(expected)} rows; {odd}"
    return None


if __name__ == "__main__":
    from weftline.queries import ORACLE_SQL, QUERIES
    from weftline.session import session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con, bad = session(cores=4), connected(sys.argv[1]), 0
    for name in names:
        try:
            found = compared(spark, con, name, QUERIES[name], ORACLE_SQL[name], sf_dir) if name in ORACLE_SQL else (None if QUERIES[name](spark, sf_dir).count() else "no rows")
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:300]}"
        if found:
            bad += 1
            print("BAD", name, found[:400])
    print(len(names), "queries,", bad, "bad")
