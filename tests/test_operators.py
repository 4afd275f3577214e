"""Operators against plain-Python folds, scalar functions against Python's own."""

import csv
import io
import random
import re
from datetime import datetime
from decimal import Decimal, InvalidOperation

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridmill.functions import convert, text
from gridmill.operators import documents, evaluate, export, match, tables
from gridmill.plans import profile
from gridmill.plans.session import tune

BASE = {"profile_schema_version": "1.0", "id": "one", "version": "1", "description": "d"}


def spec(*columns, **table):
    return BASE | {"id": "some-id", "table": {"columns": list(columns), **table}}


# -- profiles ------------------------------------------------------------------


@pytest.mark.parametrize(
    "bad",
    [
        spec(),
        spec({"name": "a", "aliases": ["Total"]}, {"name": "b", "aliases": ["total!"]}),
        spec({"name": "a", "type": "decimal", "minimum": "not-a-number"}),
        spec({"name": "a", "type": "decimal", "minimum": "NaN"}),
        spec({"name": "a", "type": "decimal", "minimum": 3, "maximum": 2}),
        spec({"name": "a", "minimum": 1}),
        spec({"name": "a", "requried": True}),
        spec({"name": "Display Name"}),
        spec({"name": "a", "aliases": ["!!!"]}),
        spec({"name": "a", "pattern": "("}),
        spec({"name": "a", "enum": []}),
        spec({"name": "a", "type": "date", "formats": []}),
        spec({"name": "a", "required": 1}),
        spec({"name": "a"}, {"name": "a"}),
        spec({"name": "a"}, header_search_rows=21),
        spec({"name": "a"}, header_search_rows=True),
        spec({"name": "a"}, minimum_header_match=0),
        spec({"name": "a"}, min_records=0),
        spec({"name": "a"}, unique_by=["b"]),
        spec({"name": "a"}, unique_by=["a", "a"]),
        spec({"name": "a"}, allow_extra_columns="yes"),
        spec({"name": "a"}) | {"profile_schema_version": "2.0"},
        spec({"name": "a"}) | {"id": "X"},
        spec({"name": "a"}) | {"more": 1},
    ],
)
def test_bad_profiles(bad):
    with pytest.raises(profile.ProfileError):
        profile.load(bad)


def test_profile_files(tmp_path, monkeypatch):
    with pytest.raises(profile.ProfileError, match="repeats"):
        profile.parse_object('{"a": 1, "a": 2}', "x")
    path = tmp_path / "p.json"
    path.write_text(profile.canonical_json(spec({"name": "a"})))
    assert profile.load(str(path)).fields == ["a"]
    assert [p["id"] for p in profile.builtin_profiles()] == ["invoice-lines-v1", "lab-coa-v1"]
    monkeypatch.setenv("GRIDMILL_ALLOWED_DIR", str(tmp_path / "inside"))
    with pytest.raises(PermissionError):
        profile.load(str(path))


# -- scalar functions ----------------------------------------------------------


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def python_decimal(raw):
    try:
        d = Decimal(raw)
    except InvalidOperation:
        return None
    return format(d, "f") if d.is_finite() else None


def test_decimals_as_python(spark):
    rng = random.Random(1)
    values = ["", "1e3", "1.50e1", "007", ".5", "5.", "1_000", "-0", "0e-3", "1,000", "NaN", "Infinity", "+.5", "--1", "1e", "١٢", "1\n", "9" * 60, "-00.100", "."]
    values += ["".join(rng.choice("0123456789.+-eE_") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    assert column(spark, values, convert.canonical_decimal) == [python_decimal(v) if v else None for v in values]


def test_integers_as_python(spark):
    values = ["0", "-0", "+007", "12", "-000", "1.0", "", "1\n", "9" * 50, "+", "1_0"]
    want = [str(int(v)) if re.fullmatch(r"[+-]?\d+", v) else None for v in values]
    assert column(spark, values, convert.canonical_integer) == want


def test_dates_as_python(spark):
    formats = ("%Y-%m-%d", "%d/%m/%Y", "%d %b %Y")
    values = ["2024-01-05", "2024-1-5", "31/12/1999", "1/2/2003", "30/02/2001", "05 Mar 2020", "5 mar 2020", "2024-13-01", "20240105", "", "2024-01-05x"]

    def one(v):
        for f in formats:
            try:
                return datetime.strptime(v, f).date().isoformat()
            except ValueError:
                pass

    assert column(spark, values, lambda c: convert.canonical_date(c, formats)) == [one(v) for v in values]
    # a directive that Python does not know reads nothing
    assert column(spark, ["2024-01-05"], lambda c: convert.canonical_date(c, ("%Q",))) == [None]


def test_bounds_are_exact(spark):
    field = profile.load(spec({"name": "v", "type": "decimal", "minimum": "0.1", "maximum": "1" + "0" * 30})).columns[0]
    values = ["0.1", "0.0999999999999999999999999", "0.10000000000000000000000001", "1" + "0" * 30, "1" + "0" * 30 + ".1", "1e40", "-5"]
    got = column(spark, values, lambda c: F.array_join(convert.check(c, field)["codes"], ","))
    assert got == ["", "below_minimum", "", "", "above_maximum", "above_maximum", "below_minimum"]


def test_headers_and_edges(spark):
    values = ["  Sample #", "Größe", "µg/L", "a__b", "Unit  Price!", " x\x1f", "日本 語", "!!!", ""]
    assert column(spark, values, text.normalize_header) == [profile.normalize_header_text(v) for v in values]
    assert column(spark, ["  x\x1c\n", "\x0b", " a b "], text.strip) == ["x", "", "a b"]


def test_spreadsheet_safety(spark):
    values = ["  =2+3", "safe\x00text", "-0.2", "\tx", "\r", "plain", "", "a=b", " @x", "\x1b+1"]
    want = ["'  =2+3", "safe\\x00text", "'-0.2", "'\tx", "'\r", "plain", "", "a=b", "' @x", "\\x1b+1"]
    assert column(spark, values, text.spreadsheet_safe) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n\r;', max_size=5), min_size=1, max_size=4))
def test_csv_lines_as_python(spark, fields):
    out = io.StringIO()
    csv.writer(out).writerow(fields)
    row = spark.createDataFrame([(fields,)], "f array<string>").select(text.csv_line(F.col("f")).alias("x")).first()
    assert row.x + "\r\n" == out.getvalue()


@pytest.mark.parametrize("page", [0, -1, True, 1.5, "1"])
def test_bad_pages(page):
    with pytest.raises(ValueError):
        documents.checked_page(page)


# -- tables --------------------------------------------------------------------

GRID = "doc_id int, table_seq int, page int, table_index int, has_merged_cells boolean"


def grids(spark, docs):
    """``docs``: lists of (page, index, rows)."""
    found = [(d, s, p, i, False) for d, ts in enumerate(docs) for s, (p, i, _) in enumerate(ts)]
    rows = [(d, s, r, c) for d, ts in enumerate(docs) for s, (_, _, grid) in enumerate(ts) for r, c in enumerate(grid)]
    return spark.createDataFrame(found, GRID), spark.createDataFrame(rows, "doc_id int, table_seq int, row int, cells array<string>")


def assessed(rows):
    widths = sorted({len(r) for r in rows})
    total, empty = sum(map(len, rows)), sum(c == "" for r in rows for c in r)
    ratio = round(empty / total, 3) if total else 1.0
    out = [f"ragged: rows have {widths} columns (grid may be misdetected)"] if len(widths) > 1 else []
    if ratio > 0.4:
        out.append(f"{int(ratio * 100)}% of cells are empty (extraction may be off)")
    return widths[0] if len(widths) == 1 else None, out


def test_assess_and_stitch_against_a_fold(spark):
    rng = random.Random(7)
    docs = []
    for _ in range(60):
        page, ts = 1, []
        for _ in range(rng.randint(1, 6)):
            width = rng.choice([2, 2, 2, 3])
            grid = [[rng.choice(["A", "B", "", "x"]) for _ in range(width)] for _ in range(rng.randint(1, 3))]
            if rng.random() < 0.15:
                grid.append(["q"] * (width + 1))
            if ts and rng.random() < 0.5:
                grid[0] = list(ts[-1][2][0])
            ts.append((page, 0, grid))
            page += rng.choice([0, 1, 1, 2])
        docs.append(ts)
    found, rows = grids(tune(spark), docs)
    stitched, lines = tables.stitch(tables.assess(found, rows), rows)
    got = {}
    for r in stitched.orderBy("doc_id", "table_seq").collect():
        got.setdefault(r.doc_id, []).append([r.merged_from_pages, r.column_count, r.warnings, r.looks_clean, []])
    seqs = {}
    for r in stitched.select("doc_id", "table_seq").orderBy("doc_id", "table_seq").collect():
        seqs.setdefault(r.doc_id, []).append(r.table_seq)
    for r in lines.orderBy("doc_id", "table_seq", "row").collect():
        got[r.doc_id][seqs[r.doc_id].index(r.table_seq)][4].append(r.cells)
    for d, ts in enumerate(docs):
        out = []
        for page, _, grid in ts:
            width, warnings = assessed(grid)
            if out and out[-1]["width"] is not None and out[-1]["width"] == width and page == out[-1]["pages"][-1] + 1:
                last = out[-1]
                last["rows"] = last["rows"] + (grid[1:] if grid[0] == last["rows"][0] else grid)
                last["pages"] = [*last["pages"], page]
                last["width"], last["warnings"] = assessed(last["rows"])
                last["warnings"].append(f"merged across pages {last['pages']} (continuation guessed from matching columns)")
            else:
                out.append({"pages": [page], "width": width, "warnings": warnings, "rows": grid})
        want = [[t["pages"] if len(t["pages"]) > 1 else None, t["width"], t["warnings"], not t["warnings"], t["rows"]] for t in out]
        assert got[d] == want


def test_empty_tables(spark):
    found, rows = grids(tune(spark), [[(1, 0, [])], [(1, 0, [["a"]])]])
    got = {r.doc_id: r for r in tables.assess(found, rows).collect()}
    assert (got[0].warnings, got[0].looks_clean, got[0].column_count) == (["empty table"], False, None)
    assert got[1].looks_clean


def test_carried_mappings_against_a_fold(spark):
    rng = random.Random(11)
    docs, facts = [], []
    for d in range(150):
        page, ts = 1, []
        for s in range(rng.randint(1, 9)):
            index = ts[-1][3] + 1 if ts and ts[-1][2] == page else 0  # numbers start again on every page
            ts.append((d, s, page, index, rng.choice(["compatible", "unmatched", "unmatched", "unmatched", "rejected"]), rng.choice([2, 2, 2, 3, None]), [s]))
            page += rng.choice([0, 1, 1, 1, 2])
        docs.append(ts)
        facts += ts
    frame = spark.createDataFrame([(*t, 0, ["h"], [(0, "f")]) for t in facts], "doc_id int, table_seq int, page int, table_index int, kind string, column_count int, mapping array<int>, header_row int, header array<string>, doubles array<struct<column:int,field:string>>")
    got = {(r.doc_id, r.table_seq): (r.kind, r.mapping) for r in match.carry_mappings(frame).collect()}
    for ts in docs:
        anchor = None
        for d, s, page, index, kind, width, mapping in ts:
            if kind == "compatible":
                anchor = (page, width, mapping)
            elif kind == "rejected":
                anchor = None
            elif anchor and page == anchor[0] + 1 and index == 0 and width is not None and width == anchor[1]:
                kind, mapping, anchor = "continued", anchor[2], (page, width, anchor[2])
            elif anchor and page not in (anchor[0], anchor[0] + 1):
                anchor = None
            assert got[d, s] == (kind, mapping), (d, s)


def test_plan_keeps_the_partitioning_by_document(spark):
    from gridmill.operators import records

    found, rows = grids(tune(spark), [[(1, 0, [["Item", "Qty", "Price"], ["a", "1", "2"]])]])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        checked = profile.load("invoice-lines-v1")
        found = found.withColumn("bbox", F.lit(None).cast("array<double>"))
        issued = records.table_issues(match.match_tables(tables.assess(found, rows), rows, checked), checked)
        plan = records.extract_records(issued, rows, checked)._jdf.queryExecution().executedPlan().toString()
        above, join, below = plan.partition(re.search(r"SortMergeJoin \[doc_id#\d+, table_seq#\d+\], .* Inner", plan)[0])
        assert "Exchange" not in above
        assert "REPARTITION_BY_COL" in re.search(r"Exchange .*", below)[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# -- evaluation and exports ----------------------------------------------------


def test_metrics(spark):
    cells = "case_id string, row long, field string, value string"
    predicted = spark.createDataFrame([("a", 0, "x", "1"), ("a", 0, "y", None), ("a", 1, "x", "2"), ("a", 1, "y", "3")], cells)
    expected = spark.createDataFrame([("a", 0, "x", "1"), ("a", 0, "y", None), ("a", 1, "x", "2"), ("a", 1, "y", "4"), ("b", 0, "x", "9"), ("b", 0, "y", "9")], cells)
    decisions = spark.createDataFrame([("a", "accepted", "accepted"), ("b", "rejected", "accepted"), ("c", "rejected", "rejected")], "case_id string, decision string, expected_decision string")
    counts = evaluate.case_counts(predicted, expected, decisions)
    total = evaluate.metrics(counts).first()
    assert (total.true_positive, total.false_positive, total.false_negative, total.exact_records, total.record_denominator) == (2, 1, 3, 1, 3)
    assert (total.field_precision, total.field_recall, total.field_f1) == (0.666667, 0.4, 0.5)
    assert evaluate.metrics(counts, by_case=True).where("case_id = 'c'").first().field_precision == 1.0
    assert evaluate.gate(evaluate.metrics(counts), {}).first().passed
    assert not evaluate.gate(evaluate.metrics(counts), {"field_recall": 0.5}).first().passed
    with pytest.raises(ValueError):
        evaluate.gate(evaluate.metrics(counts), {"speed": 1})
    with pytest.raises(ValueError):
        evaluate.gate(evaluate.metrics(counts), {"field_f1": True})


def test_notations_of_other_scripts_and_formats(spark):
    def column(kind, **more):
        return profile.load({"profile_schema_version": "1.0", "id": "one", "version": "1", "description": "one", "table": {"columns": [{"name": "x", "type": kind, **more}]}}).columns[0]

    def read(texts, field):
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
        return [(r.c.value, list(r.c.codes)) for r in frame.select("i", convert.check(F.col("x"), field).alias("c")).orderBy("i").collect()]

    assert read(["٣٤", "-०७", "+00", "1٢", "²"], column("integer")) == [("34", []), ("-7", []), ("0", []), ("12", []), ("²", ["invalid_type"])]
    assert read(["1e3", "1_000", "٣.٥", "x"], column("decimal")) == [("1000", []), ("1000", []), ("3.5", []), ("x", ["invalid_type"])]
    assert read(["2024-060", "29 Feb 2024 13:05", "2024-02-30"], column("date", formats=["%Y-%j", "%d %b %Y %H:%M"])) == [("2024-02-29", []), ("2024-02-29", []), ("2024-02-30", ["invalid_type"])]
    for pattern, good, bad in ((r"(?P<y>a)(?P=y)", "aa", "ab"), (r"\w+", "é_1", "a b"), (r"\d{2}", "٣٤", "3"), (r"[A-Z]{2}-[0-9]+", "AB-1", "AB-1x"), (r"a.c", "a\u2028c", "abcd"), (r"x(?=y)y", "xy", "xz")):
        assert [c for _, c in read([good, bad], column("string", pattern=pattern))] == [[], ["pattern_mismatch"]], pattern


@pytest.mark.parametrize("text", ["ΑΣ Σας", "ﬁne ﬂow", "STRASSE ẞ ß", "İstanbul", "ŉ ǰ ΐ", "Ꭰꭰ", "ſ µ ϐ ᾳ", "plain ASCII-text", ""])
def test_headers_are_case_folded(spark, text):
    from gridmill.functions.text import normalize_header

    assert spark.createDataFrame([(text,)], "x string").select(normalize_header(F.col("x"))).first()[0] == profile.normalize_header_text(text)


def test_sheet_titles():
    used = {"Review"}
    assert [export.safe_sheet_title(t, used) for t in ("Table 1", "Table 1", "a/b", "", "x" * 40, "x" * 40)] == ["Table 1", "Table 1 2", "a b", "Table", "x" * 31, "x" * 29 + " 2"]


def test_casefold_and_headers_of_any_character(spark):
    """Every character that folds otherwise than by lowering, alone and inside words, as Python folds it."""
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c).lower()]
    texts = [f"A{c}b {c}" for c in odd] + ["ΟΔΟΣ Straße µ ſ", "İx", "Plain  Text_1!", "É À", "", "!!", "a\nB"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select("t", text.casefold(F.col("t")).alias("f"), text.normalize_header(F.col("t")).alias("h")).collect()
    for r in got:
        assert r.f == r.t.casefold()
        if r.t.isascii():
            assert r.h == re.sub(r"[^a-z0-9_]+", " ", r.t.lower()).strip(" ")
    # the table of all folds is only met by texts with a rare character
    assert re.search(text._RARE, "straße µ ſ ς") is None and all(re.search(text._RARE, c.lower()) or c.lower() in text._COMMON_FOLDS for c in odd)


def test_cells_are_compared_as_bags_in_nested_records(spark):
    from gridmill.operators import evaluate

    rng = random.Random(4)
    side = lambda: [(rng.randrange(3), rng.randrange(4), rng.choice("ab"), rng.choice(["x", "y", None])) for _ in range(60)]
    p, e = side(), side()
    frames = [spark.createDataFrame(x, "case_id long, row long, field string, value string") for x in (p, e)]
    got = {r.case_id: (r.true_positive, r.false_positive, r.false_negative, r.exact_records, r.predicted_records, r.expected_records) for r in evaluate.compare_records(*map(evaluate.nested, frames)).collect()}
    from collections import Counter

    for case in {x[0] for x in p + e}:
        mine, other = (Counter(x for x in s if x[0] == case and x[3] is not None) for s in (p, e))
        rows = [{k: sorted((x[2:] for x in s if x[:2] == (case, k)), key=repr) for k in {x[1] for x in s if x[0] == case}} for s in (p, e)]
        same = sum((mine & other).values())
        exact = sum(rows[0][k] == rows[1].get(k) for k in rows[0])
        assert got[case] == (same, sum(mine.values()) - same, sum(other.values()) - same, exact, len(rows[0]), len(rows[1]))


def test_big_stages_are_left_to_methods_that_the_jvm_compiles(spark):
    assert int(tune(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_keys_are_compared_before_an_arrow_function(spark):
    """Above the first Arrow function nothing is shuffled: the windows over keys lie below it."""
    from gridmill import queries
    from gridmill.operators import records

    found = queries._extraction(spark, "/root/testdata/sf0.001")
    plan = records.unique_check(records.extract_records(found._matched, found._grid_rows, found.profile), found.profile)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan[: plan.index("ArrowEvalPython")] and plan.count("Window") >= 2
    found.release()


def test_bounds_where_doubles_are_equal(spark):
    bounds = [Decimal(b) for b in ("0", "0.1", "90000", "-2.5", "9007199254740993", "100000000000000000000000000000000000000001", "1" + "0" * 400)]
    texts = ["0", "0.1", "0.10000000000000001", "0.09999999999999999", "90000", "90000.000000000000000000001", "89999.99999999999999999", "-2.5", "-2.50000000000000000000001",
             "9007199254740992", "9007199254740993", "9007199254740994", "100000000000000000000000000000000000000000", "100000000000000000000000000000000000000002", "9" * 400, "1" + "0" * 401, "-" + "9" * 500, "-3", None]
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    for jvm in (False, True):
        for r in rows.select("v", *[convert._sign(F.col("v"), b, jvm).alias(f"s{i}") for i, b in enumerate(bounds)]).collect():
            want = [None] * len(bounds) if r.v is None else [(Decimal(r.v) > b) - (Decimal(r.v) < b) for b in bounds]
            assert list(r[1:]) == want, r.v
