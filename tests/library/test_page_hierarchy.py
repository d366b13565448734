"""Kicker, headline and body of odd texts, against the SQL of the query."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quoin.queries import SQL, page_hierarchy

TEXTS = [
    "0 first\n1 second 1\n2\n30\n3 fourth 3",  # lines that begin or end with their own numbers
    "\n".join(f"{n} line {n}" for n in range(25)),
    "   A headline of a page   \n  KICKER  \n rest \n\n  ",
    "  Wide spaces　\n LOUD \n \n body  here ",
    "\ttabs\t\n\t\nBODY\t\twith\x0btabs\r\nmore\f\n",
    "one two three four five six seven eight nine ten eleven\x0btwelve thirteen\nsecond line",
    "Headline\nOﬃCE\nSTRAßE\nREST\nrest",
    "Headline\nᾈ OF ŉ\nbody",
    "", " \n \n", None, "\n", "ab", "x" * 100 + "\nshort", "ALONE", "SAME\nSAME\nOTHER",
    "😀".encode("utf-16", "surrogatepass").decode("utf-16") * 800 + "\nHead line\n" + "b " * 500,
]


def test_page_hierarchy_as_in_sql(spark, tmp_path):
    table = pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string())})
    pq.write_table(table, tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, kicker, headline, body FROM ({SQL['page_hierarchy']}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in page_hierarchy(spark, str(tmp_path)).select("doc_id", "kicker", "headline", "body").orderBy("doc_id").collect()]
    assert got == want


def test_lines_keep_their_numbers(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": [1], "text": ["00 head\n1 KICK 1\n2 body 2"]}), tmp_path / "documents.parquet")
    r = page_hierarchy(spark, str(tmp_path)).first()
    assert (r.headline, r.kicker, r.body) == ("00 head", "1 KICK 1", "2 body 2")
