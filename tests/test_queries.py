"""Every query of the reconciliation tables against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from ledgerloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, want.fetchall())
    assert got and got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_without_the_llm_folder():
    import ast

    import ledgerloom

    root = os.path.dirname(ledgerloom.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    tree = ast.parse(open(os.path.join(folder, f), encoding="utf-8").read())
                    names = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                    assert not any("llm" in n.split(".") for n in names), f


def test_index_replace_on_letters_without_a_single_upper_case(spark, tmp_path):
    texts = ["straße ß aß ŉa", "der ß Weg, die ß Straße", "İstanbul ΟΔΟΣ ΣΑΣ ﬁn 𐐨𐐩x ß", "plain words", None]
    docs = [(i, t, "en", f"src{i % 4}", 0) for i, t in enumerate(texts * 8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "straße weg"), (1, "οδος istanbul plain ﬁn")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df, want = catalog.QUERIES["index_replace"](spark, str(tmp_path)), con.execute(catalog.ORACLE_SQL["index_replace"])
    names = [c[0] for c in want.description]
    got, want = rows(df.columns, df.collect()), rows(names, want.fetchall())
    assert got and got == want


LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def lineitem(spark, folder, lines):
    """A table of (order, part, supplier, line, quantity, price, discount, tax, flag, status, date) in the order given."""
    from datetime import datetime

    spark.createDataFrame([(*x[:10], datetime.fromisoformat(x[10])) for x in lines], LINE).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return con


def test_pricing_merge_where_lines_of_two_roles_have_one_place(spark, tmp_path):
    both = [(1, 5001, 7, 1, 9.0, 100.0, 0.1, 0.05), (1, 1, 7, 2, 3.0, 200.0, 0.0, 0.08), (2, 5001, 7, 1, 2.0, 100.0, 0.1, 0.05), (2, 1, 7, 2, 3.0, 200.0, 0.0, 0.08)]
    null = [(3, 4, 7, 2, None, 50.0, 0.0, 0.04), (3, 4, 7, 2, 6.0, 70.0, 0.0, 0.03)]
    con = lineitem(spark, tmp_path, [(*x, "N", "O", "1996-01-01") for x in both + null])
    df, want = catalog.QUERIES["pricing_merge"](spark, str(tmp_path)), con.execute(catalog.ORACLE_SQL["pricing_merge"])
    names = [c[0] for c in want.description]
    got, want = rows(df.columns, df.collect()), rows(names, want.fetchall())
    assert got and got == want


def test_review_decisions_do_not_depend_on_the_order_of_tied_lines(spark, tmp_path):
    lines = [(k, k, 1, 5, 12.0, 10.0, 0.0 if k % 2 else 0.05, 0.0, "R" if k % 3 else "N", "F", day) for k in range(1, 9) for day in ("1995-06-01", "1997-06-01")]
    lines += [(20, 3, 1, 1, None, 10.0, 0.05, 0.05, "A", "F", "1995-06-01"), (20, 4, 1, 1, 7.0, 10.0, 0.05, 0.05, "R", "F", "1995-06-01")]
    lineitem(spark, tmp_path / "a", lines)
    con = lineitem(spark, tmp_path / "b", lines[::-1])
    a, b = (catalog.QUERIES["review_decisions"](spark, str(tmp_path / x)) for x in "ab")
    got = rows(a.columns, a.collect())
    assert got and got == rows(b.columns, b.collect())
    want = con.execute(catalog.ORACLE_SQL["review_decisions"]).fetchall()
    assert [x for x in got if "'20" in x] == [x for x in rows(["kind", "id", "what"], want) if "'20" in x]


def test_open_review_events_make_their_events_once(spark):
    files = catalog.QUERIES["open_review_events"](spark, SF).inputFiles()
    assert files and not any("lineitem" in f or "orders" in f for f in files)


def test_similar_spellings_are_looked_for_without_documents(spark):
    from ledgerloom.operators import entities

    docs = spark.createDataFrame([(i, ["SO123", "X", "12"]) for i in range(3)] + [(9, ["SO12", "S0123"])], "doc_id long, found array<string>")
    index = spark.createDataFrame([("SO123",), ("SO124",), ("SO9",), ("12",)], "alias string")
    got = entities.similar(docs, index)
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, "SO123", a) for i in range(3) for a in ("SO123", "SO124")] + [(9, "SO12", a) for a in ("SO123", "SO124")])
    wide = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(" in x and "form#" in x]
    assert wide and not any("doc_id" in x for x in wide)
