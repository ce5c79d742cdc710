"""All queries of the library by name, and the same queries as SQL."""

from __future__ import annotations

from weftline.operators.archive import archive
from weftline.operators.folders import folders
from weftline.operators.runs import runs
from weftline.operators.web import web

QUERIES = web.queries | runs.queries | archive.queries | folders.queries
ORACLE_SQL = web.sql | runs.sql | archive.sql | folders.sql
