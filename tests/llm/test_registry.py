"""Every query with SQL against that SQL, on small tables with odd rows."""

import random

import duckdb
import pytest

from seriesloom.llm import registry

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
    "pages": "page_id long, url string, html string",
}


def make():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)] + ["É", "日本", "A-b", "c.", "(x)"]
    text = lambda n: rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(n))
    base = [text(rng.choice([0, 1, 3, 4, 12, 40, 120])) for _ in range(30)]
    docs = base + [b.upper() for b in base[:6]] + [b + " w1" for b in base[6:16]] + [None, "", " \t\n"]
    items = [(i, " ".join(d.split()[3:20])) for i, d in enumerate(docs[:12]) if d] + [(50, "w1 w2"), (51, "w3"), (None, docs[5]), (52, None), (53, "")]
    turns = [(c, t, "user", text(rng.choice([1, 5, 20]))) for c in range(6) for t in range(5)] + [(7, 0, "user", None), (None, 1, "user", "x"), (3, 2, "user", "again\n> w1")]
    pages = [(i, f"http://h{i % 3}/{i}", f"<p>{text(9)}</p>") for i in range(120)] + [(7, None, None)]
    return {"documents": [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)], "benchmark": items, "conversations": turns, "pages": pages}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    for name, rows in make().items():
        spark.createDataFrame(rows, TABLES[name]).repartition(2).write.parquet(str(where / f"{name}.parquet"))
    return where


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    out = registry.QUERIES[name](spark, str(folder))
    names = sorted(out.columns)
    plain = lambda r: tuple(round(v, 4) if isinstance(v, float) else v for v in r)
    got = sorted((plain(r) for r in out.select(*names).collect()), key=str)
    listed = ", ".join(f'"{n}"' for n in names)
    want = sorted((plain(r) for r in con.execute(f"select {listed} from ({registry.SQL[name]})").fetchall()), key=str)
    assert got == want and got
