"""What keeps an extraction in proportion to its input: no Python workers, rows laid once, nothing made that is not read."""

import random
import re

from pyspark.sql import functions as F

from gridmill import queries
from gridmill.functions import convert
from gridmill.operators import evaluate, export, match
from gridmill.plans import profile, store
from gridmill.plans.extraction import extract
from gridmill.plans.grids import ORDER_PROFILE, order_grid
from gridmill.plans.session import tune


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_read_in_the_jvm_as_python_reads_them(spark):
    rng = random.Random(8)
    texts = ["0E+3", "1__2", "_1_", "1e+_5", "_ 1", "000e5", "0.00e-2", "0e99999999999999999999", "1e-99999999999999999999", "-0e3", "007e1", "1e05", "_", "e5", ".", ".e1", "1.e2", "+.5E-3", "12e-1", "-1_0.50e1", "٣.٥", "-०७e1", "1e9999", "1e10000", "123e-10001", "1e-9999"]
    texts += ["".join(rng.choice("0123456789..__eE+-٣٥१ ") for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    texts = [t.strip() for t in texts]
    field = profile.load({"profile_schema_version": "1.0", "id": "one", "version": "1", "description": "one", "table": {"columns": [{"name": "x", "type": "decimal", "minimum": "-12.50", "maximum": "90000"}]}}).columns[0]
    values = texts + [s + d for s in ("", "-") for d in ("12.50", "12.5000000000000000000000", "12.50000000000000000000001", "12.4999999999999999999999", "90000.00000000000000000000", "90000.00000000000000000001", "89999.99999999999999999999", "0.0000000000000000000000", "99999999999999999999999999")]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(values)], "i int, x string").select("i", "x", convert.plain(F.col("x"), field).alias("p"))
    for jvm in (False, True):
        frame = frame.withColumn(f"v{jvm}", convert.completed(F.col("x"), F.col("p"), field, jvm))
    frame = frame.select("*", *[convert.codes(F.col("x"), F.col("vFalse"), field, jvm).alias(f"c{jvm}") for jvm in (False, True)])
    rows = frame.collect()
    assert [(r.x, r.vTrue, r.cTrue) for r in rows] == [(r.x, r.vFalse, r.cFalse) for r in rows]
    assert sum(r.vTrue is not None for r in rows) > 300


def test_rows_of_the_order_grid_stay_where_their_lines_were_numbered(spark):
    rows = order_grid(tune(spark), "/root/testdata/sf0.001")[2]
    assert _plan(rows.groupBy("doc_id", "table_seq").agg(F.count("*"))).count("Exchange ") == 1


def test_records_need_no_python_worker_and_only_what_is_read_is_made(spark):
    found = queries._extraction(spark, "/root/testdata/sf0.001", once=True)
    assert "ArrowEvalPython" not in _plan(found.wide)
    assert "decimal(38,18)" in _plan(found.wide) and "decimal(38,18)" not in _plan(found.places)
    assert found.places.count() == found.wide.count() == queries.record_index(spark, "/root/testdata/sf0.001").count()
    found.release()


def test_wide_sides_are_compared_as_nested_ones(spark):
    rng = random.Random(5)
    side = lambda: {(rng.randrange(3), rng.randrange(9)): (rng.choice(["x", "y", None]), rng.choice(["x", None])) for _ in range(30)}
    frames = [spark.createDataFrame([(*k, *v) for k, v in side().items()], "case_id long, row long, a string, b string") for _ in range(2)]
    long = [f.select("case_id", "row", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in "ab"]))) for f in frames]
    cases = spark.range(4).withColumnRenamed("id", "case_id")
    counts = [sorted(map(tuple, evaluate.record_counts(*sides, cases).collect())) for sides in (frames, long)]
    assert counts[0] == counts[1]
    shuffled = _plan(evaluate.record_counts(*frames, cases))
    assert not re.search(r"array<struct<field", shuffled)


def test_decisions_need_no_list_of_issues(spark):
    found = queries._extraction(tune(spark), "/root/testdata/sf0.001")
    counted = {r.doc_id: r.decision for r in found.documents.collect()}
    assert {r.doc_id: r.decision for r in found.verdicts.collect()} == counted
    assert set(counted.values()) == {"accepted", "needs_review", "rejected"}
    assert "to_json" not in _plan(queries.decision_pivot(spark, "/root/testdata/sf0.001"))
    found.release()


def test_decisions_of_documents_without_tables_records_or_with_one_flaw(spark):
    head, row = ["Item", "Qty", "Price"], ["a", "1", "2.5"]
    grids = {1: [], 2: [[head]], 3: [[head, row]], 4: [[head, row, row]], 5: [[head, ["a", "x", "1"]]], 6: [[["Item", "Qty", "Remark"], row]], 7: [[head, row], [["Item", "Code"], row]], 8: [[["q", "r"], row]]}
    rows = [(d, t, i, cells) for d, ts in grids.items() for t, rs in enumerate(ts) for i, cells in enumerate(rs)]
    tables = sorted({(d, t, t + 1, 0) for d, t, _, _ in rows})
    given = [spark.createDataFrame([(d,) for d in grids], "doc_id long"), spark.createDataFrame(tables, "doc_id long, table_seq int, page int, table_index int"), spark.createDataFrame(rows, "doc_id long, table_seq int, row int, cells array<string>")]
    named = given[2].join(given[1], ["doc_id", "table_seq"])
    for grid in (given, [given[0], None, named]):
        found = extract(*grid, ORDER_PROFILE)
        counted = {r.doc_id: r.decision for r in found.documents.collect()}
        assert {r.doc_id: r.decision for r in found.verdicts.collect()} == counted
        assert counted == {1: "rejected", 2: "rejected", 3: "accepted", 4: "needs_review", 5: "needs_review", 6: "rejected", 7: "needs_review", 8: "rejected"}
        found.release()


def test_header_names_are_found_in_whole_rows_as_in_single_cells(spark):
    of = profile.load(ORDER_PROFILE)
    rng = random.Random(3)
    cells = ["Item", " DESCRIPTION ", "quantity:", "Unit  price!", "unit_price", "", " ", None, "\0", "Qty\0", "a\0Item", "P12", "12", "many", "\n", "Item\n", "ÏTEM", "-"]
    rows = [(i, [rng.choice(cells) for _ in range(rng.randint(0, 4))]) for i in range(400)] + [(i, [c]) for i, c in enumerate(cells)]
    frame = spark.createDataFrame(rows, "i int, cells array<string>")
    one = F.transform("cells", lambda c: F.element_at(match.alias_map(of), match.normalize_header(c)))
    got = frame.select("cells", match.fields_of(F.col("cells"), of).alias("f"), one.alias("one")).collect()
    assert [(r.cells, r.f) for r in got] == [(r.cells, r.one) for r in got]
    assert sum(any(r.f) for r in got) > 100


def test_tables_of_the_order_grid_are_met_in_their_rows(spark):
    found = queries._extraction(tune(spark), "/root/testdata/sf0.001")
    plain = extract(*order_grid(spark, "/root/testdata/sf0.001"), ORDER_PROFILE, laid=True)
    columns = ["doc_id", "table_seq", "page", "table_index", "kind", "header_row"]
    both = [sorted(map(tuple, e._matched.select(columns).collect()), key=repr) for e in (found, plain)]
    assert both[0] == both[1]
    # what is kept of records for issues holds no texts
    assert {c for c in found._values.columns if c.startswith(("raw", "value"))} == set()
    found.release()
    plain.release()


def test_results_are_made_where_rows_lie_without_writing_records(spark, monkeypatch):
    head, names = ["Item", "Qty", "Price"], ["a", "b", "a", "", "c", "a", "b", "a"]
    grids = {1: [[head, *[[x, str(i), "2.5"] for i, x in enumerate(names)]], [["a", "x", "-1"]]], 2: [[head]], 3: [], 4: [[["Date", "Who"], ["", ""]]], 5: [[head, ["q", "1", "3"]]]}
    rows = [(d, t, t + 1, 0, i, cells) for d, ts in grids.items() for t, rs in enumerate(ts) for i, cells in enumerate(rs)]
    documents = spark.createDataFrame([(d, "grid", 0, f"s{d}", f"f{d}") for d in grids], "doc_id long, type string, bytes long, sha256 string, fingerprint string")
    rows = spark.createDataFrame(rows, "doc_id long, table_seq int, page int, table_index int, row int, cells array<string>").repartition("doc_id")
    whole = extract(documents, None, rows, ORDER_PROFILE)
    want = {r.doc_id: r.json for r in export.result_json(whole, documents).collect()}
    written, write = {}, store.materialise
    monkeypatch.setattr(store, "materialise", lambda frame, name, *more: written.setdefault(name, frame.columns) and write(frame, name, *more))
    parts = extract(documents, None, rows, ORDER_PROFILE, laid=True, parts=("column", "codes", "tables"))
    assert {r.doc_id: r.json for r in export.result_json(parts, documents).collect()} == want
    assert want[1].count("duplicate record key") > 8 and want[5].count('"decision":"accepted"') == 1
    written.clear()
    got = queries.result_json(tune(spark), "/root/testdata/sf0.001")
    assert {c for columns in written.values() for c in columns if c.startswith(("raw", "value", "bbox0"))} == set()
    # no record is shuffled: exchanges carry lines, tables, issues and documents
    assert not re.search(r"Exchange[^\n]*\n[^\n]*collect_list\(r#", _plan(got))
    plain = export.result_json(extract(*order_grid(spark, "/root/testdata/sf0.001"), ORDER_PROFILE, laid=True), queries._named(order_grid(spark, "/root/testdata/sf0.001")[0]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    whole.release()
    parts.release()
