"""Local schema check: Spark column types of every registered query vs the
types of its DuckDB oracle (the driver compares schemas as well as values).

Usage: python tests/schema_check.py [sf_dir]
"""
import sys
sys.path.insert(0, __import__('os').path.dirname(__import__('os').path.dirname(__import__('os').path.abspath(__file__))))
import duckdb
import __spark_entry__ as E
from quotaflow.session import build_session
sf = sys.argv[1] if len(sys.argv) > 1 else '/root/testdata/sf0.001'
spark = build_session()
con = duckdb.connect()
for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
M = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
     "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}
qs, sql = E.queries(), E.oracle_sql()
for name in qs:
    df = qs[name](spark, sf)
    st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rel = con.sql(sql[name])
    dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
    bad = [(c, st[c], dt.get(c)) for c in st if M.get(st[c], st[c]) != dt.get(c)]
    if bad:
        print(name, bad)
print("done")
