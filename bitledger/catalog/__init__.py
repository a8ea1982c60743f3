"""Every operator as a query over the test tables, with the SQL that must give the same rows."""

from bitledger.catalog import accuracy, analysis, corpus, engine, files, scoring, vectors

_PARTS = [files, analysis, accuracy, engine, corpus, vectors, scoring]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
