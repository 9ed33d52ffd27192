"""Queries whose SQL is compared on texts that the test tables lack."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from lodestone.plans import queries


def compare(spark, folder, name, table, columns):
    """The query's rows and its SQL's, both in order, over one table of these columns."""
    at = f"{folder}/{table}.parquet"
    pq.write_table(pa.table(columns), at)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}'")
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, str(folder)).select(*names).collect()
    order = lambda rows: sorted(map(tuple, rows), key=str)
    return order(got), order(want.fetchall())


HINTS = [
    'A line.\nIt has token = "58ed"',
    'A line.\n"quoted" to the "end"',
    "A line.\n'''Said.'''",
    "A line.\nreturn of it",
    "A line.\nfor all, with none",
    "A line.\n\n  # note\n // note\n    \n  spaced 'so'  \nmore",
    "A line.\n\u00a0\u3000\nmore",
    "A line.\n\u2003wide\u00a0\nmore",
    "A line.\n\ttabbed\t\r\nmore",
    "A line.\n# only",
    "A line.\n" + "\u00e9\U0001f600" * 90,
    "one line",
    "\n",
    "",
    None,
]


def test_map_signatures(spark, tmp_path):
    ids = [*range(len(HINTS)), -3, -2, None]
    got, want = compare(spark, tmp_path, "map_signatures", "documents", {"doc_id": pa.array(ids, pa.int64()), "text": [*HINTS, *HINTS[:3]]})
    assert got == want and len(want) == len(HINTS) + 1


def test_hints_of_lines_beyond_a_million(spark, tmp_path):
    got, want = compare(spark, tmp_path, "map_signatures", "documents", {"doc_id": [1], "text": ["first" + "\n" * 1_000_002 + "last"]})
    assert got == want == [(1, "first", "last")]


LEADS = [
    "what is the end",
    "The what are ends",
    "the the end",
    "please find the end",
    "How it ends",
    "THE\n end",
    "the\x0bend",
    "the\u00a0end",
    "\tthe end\t",
    "\nthe end",
    "\u00a0the \u2003end\u3000",
    "end\nthe end",
    "there",
    "the ",
    "show me",
    " ",
    "",
    None,
]


def test_strip_prefixes(spark, tmp_path):
    ids = list(range(len(LEADS)))
    got, want = compare(spark, tmp_path, "strip_prefixes", "conversations", {"conv_id": ids, "turn": [0] * len(ids), "text": LEADS})
    assert got == want and len(want) == len(LEADS)
