import duckdb

from seriesloom.llm import quotelink as Q

ROWS = [
    (1, 0, "user", "Hello all\nsecond line\n\nnew paragraph here", 0),
    (1, 1, "assistant", "> Hello all\n> second line\nI agree", 0),
    (1, 2, "user", "On Monday, A wrote:\n> > Hello all\n> I agree\nMe too\n", 0),
    (1, 3, "user", ">new   PARAGRAPH here\n\nfine", 0),
    (1, 5, "user", "> nobody said this\nodd", 0),
    (1, 4000, "user", ">>Me too\n> odd\nlate", 0),
    (2, 0, "user", None, 0),
    (2, 1, "user", "", 0),
    (2, 2, "user", "> Hello all", 0),
    (3, 0, "user", "same", 0),
    (3, 1, "user", "same\n> same", 0),
    (3, 2, "user", "> same\r\nx", 0),
    (3, 2, "user", "> same\r\nx", 0),
    (None, 0, "user", "> same", 0),
    (3, None, "user", "> same", 0),
    (4, 7, "user", "line\n" * 3000 + "> line", 0),
]


def result(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")
    return Q.link(df).collect()


def test_links_threads_and_clean_text(spark):
    got = result(spark, ROWS)
    assert len(got) == len(ROWS)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].reply_turn == 0 and by[1, 1].linked and by[1, 1].clean_text == "I agree"
    assert (by[1, 2].reply_turn, by[1, 2].thread_turn, by[1, 2].clean_text, by[1, 2].n_quoted) == (1, 0, "Me too", 2)
    assert by[1, 3].reply_turn == 0 and by[1, 3].clean_text == "fine"
    assert by[1, 5].reply_turn == 3 and not by[1, 5].linked and by[1, 5].thread_turn == 5
    assert (by[1, 4000].reply_turn, by[1, 4000].thread_turn) == (5, 5)
    assert by[2, 1].reply_turn == 0 and by[2, 2].clean_text == ""
    assert by[3, 2].reply_turn == 0 and by[3, 1].reply_turn == 0
    assert by[None, 0].reply_turn is None and by[3, None].reply_turn is None


def test_equals_sql(spark):
    got = sorted(map(tuple, result(spark, ROWS)), key=str)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar, depth int)")
    con.executemany("insert into conversations values (?,?,?,?,?)", ROWS)
    want = sorted(con.execute(Q.sql()).fetchall(), key=str)
    assert got == want


def test_no_python_and_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = Q.link(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_deep_and_long_lines(spark):
    deep = ">" * 100_000 + " so"
    rows = [(1, 0, "user", "so", 0), (1, 1, "user", deep + "\nwhat", 0), (1, 2, "user", " > " * 20_000 + "\n" + " " * 100_000 + "\nend", 0), (1, 3, "user", "a" * 1_000_000 + "\n> what", 0)]
    rows += [(2, 0, "user", "\n".join(f"line {i}" for i in range(4000)), 0), (2, 1, "user", "\n".join(f"{'>' * (i % 400 + 1)} line {i}" for i in range(4000)), 0)]
    got = {(r.conv_id, r.turn): r for r in result(spark, rows)}
    assert got[1, 1].linked and got[1, 1].reply_turn == 0 and got[1, 1].clean_text == "what"
    assert got[1, 2].clean_text == "end" and got[1, 3].reply_turn == 1 and got[1, 3].linked
    assert got[2, 1].linked and got[2, 1].n_quoted == 4000


def test_derived_quotes_link_to_what_they_quote(spark, tmp_path):
    texts = ["How are you all, #?\nSecond line #.\n\nAnother passage #", "Fine, thanks. And you, #?", "Well enough #\nso far", "Good to hear"]
    rows = [(c, t, "user", f"{texts[t % 4]} {c} {t}".replace("#", str(t))) for c in range(12) for t in range(9)] + [(None, 1, "user", "x"), (3, None, "user", None), (3, 4, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    from seriesloom.llm import registry

    got = registry.op4_quotelink(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    ways = {(r.conv_id, r.turn): (r.conv_id * 7 + r.turn * 3) % 5 for r in got if r.conv_id is not None and r.turn}
    linked = [r for r in got if r.linked]
    assert len(linked) == sum(w != 0 for w in ways.values()) + (ways[3, 4] != 0)
    assert all(r.reply_turn == r.turn - 1 for r in linked)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = sorted(con.execute(registry.SQL["op4_quotelink"]).fetchall(), key=str)
    assert sorted(map(tuple, got), key=str) == want
