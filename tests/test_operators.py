"""Own operators: fixed examples, a sequential model of the merge, and the SQL of every query."""

import io
import random
import re
import time
import zipfile
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cloakwork.functions import numbers as N
from cloakwork.functions import text as T
from cloakwork.operators import align, answers, documents, grid, mask, pages
from cloakwork.operators.reconcile import reconcile
from cloakwork.operators.scan import scan
from cloakwork.patterns import JS_WS, PATTERNS, PY_WS
from cloakwork.plans import queries as own
from cloakwork.sources import csv_spans, sheets, word

TEXT = """Tender 7, offers as received

Offer of Vendor TH-204 for the north site
Bid: EUR 3,410,775.50 and EUR 12M later
Bond 2.25% of the bid, fee 12 %
Checked against IDN-9 (Kali Besar Works), whose bid was 980,040"""
SUGGESTED = [("Vendor Name", "TH-204"), ("Vendor Name", "kali  besar works"), ("Price", "EUR 3,410,775.50"), ("Percentage", "2.25%"), ("Price", "GBP 71,000")]


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    given = [(i, k, f, v, None, None) for i, (_, s) in enumerate(rows) for k, (f, v) in enumerate(s)]
    return docs, spark.createDataFrame(given, "doc_id long, ai_seq int, field_name string, original_value string, reason string, sensitivity string")


def test_example(spark):
    docs, given = tables(spark, [(TEXT, SUGGESTED)])
    assert [r["value"] for r in scan(docs).orderBy("seq").collect()] == ["EUR 3,410,775.50", "EUR 12M", "3,410,775.50", "980,040", "2.25%", "12 %", "TH-204", "IDN-9", "Vendor TH-204"]
    found = [tuple(r) for r in reconcile(docs, given).orderBy("position").select("field_id", "original_value", "source", "confidence", "occurrences", "verified").collect()]
    assert found == [
        ("vendor_name_1", "TH-204", "ai+pattern", 100, 1, True), ("vendor_name_2", "Kali Besar Works", "ai", 90, 1, True), ("vendor_name_3", "IDN-9", "pattern", 75, 1, True), ("vendor_name_4", "Vendor TH-204", "pattern", 75, 1, True),
        ("price_1", "EUR 3,410,775.50", "ai+pattern", 100, 1, True), ("price_2", "EUR 12M", "pattern", 75, 1, True), ("price_3", "980,040", "pattern", 75, 1, True),
        ("price_4", "GBP 71,000", "ai", 40, 0, False), ("percentage_1", "2.25%", "ai+pattern", 100, 1, True), ("percentage_2", "12 %", "pattern", 75, 1, True),
    ]


def model(text, given):
    """The merge, one suggestion and one hit after the other."""
    plain = lambda s: re.sub(r"\s+", " ", s).strip().lower()
    hits, seen = [], set()
    for p in PATTERNS:
        for m in re.finditer(p.java.replace(JS_WS, PY_WS), text, re.A):
            if (k := (p.category, plain(m[0]))) not in seen:
                seen.add(k)
                hits.append((p.category, m[0].strip()))
    found, taken = [], {}
    for name, value in given:
        value = re.sub(r"\s+", " ", value).strip()
        if len(value) < 2 or plain(value) in taken:
            continue
        places = re.findall(re.escape(value).replace(r"\ ", r"\s+"), text, re.I)
        final = re.sub(r"\s+", " ", places[0]) if places else value
        agrees = any(plain(h) in plain(final) for _, h in hits)
        found.append((name, final, "ai+pattern" if places and agrees else "ai", (100 if agrees else 90) if places else 40, len(places)))
        taken[plain(final)] = bool(places)
    for name, value in hits:
        if plain(value) in taken or any(ok and plain(value) in k for k, ok in taken.items()):
            continue
        places = re.findall(re.escape(value).replace(r"\ ", r"\s+"), text, re.I)
        found.append((name, re.sub(r"\s+", " ", places[0]), "pattern", 75, len(places)))
        taken[plain(value)] = True
    return sorted(found, key=lambda f: ({"Vendor Name": 0, "Price": 1, "Percentage": 2}.get(f[0], 9), -f[3]))


def test_merge_equals_a_sequential_model(spark):
    draw = random.Random(11)
    bits = ["TH-204", "IDN-9", "Vendor TH-204", "USD 8,125", "8,125", "EUR 3,410,775", "31%", "2.25 %", "$ 4K-9K/MW", "66 MW", "EUR 2.5M", "total", "the", "\n", "Kali Besar"]
    rows = []
    for _ in range(150):
        text = " ".join(draw.choices(bits, k=draw.randrange(0, 14)))
        given = [(draw.choice(["Vendor Name", "Price", "Percentage", "Other"]), draw.choice([*bits, "kali  besar", "usd 8,125", "EUR 999", "x", "th-204"])) for _ in range(draw.randrange(0, 5))]
        rows.append((text, given))
    docs, given = tables(spark, rows)
    found = {}
    for r in reconcile(docs, given).orderBy("doc_id", "position").collect():
        found.setdefault(r["doc_id"], []).append((r["field_name"], r["original_value"], r["source"], r["confidence"], r["occurrences"]))
    for i, (text, s) in enumerate(rows):
        assert found.get(i, []) == model(text, s), (text, s)


def test_numbers_and_sweep(spark):
    df = spark.createDataFrame([("150M",), ("SG-01",), ("USD 2,500",), ("7%",), ("",)], "v string")
    assert [r[0] for r in df.select(N.extract_numbers(F.col("v"))).collect()] == [[150.0, 150e6], [], [2500.0], [7.0], []]
    cells = {"411,960.95": True, "$ 1,254.40": True, "SGD 150M": True, "usd 11.75m/MW": True, "12%": True, "$ -": True, "17": False, "~USD 5": False, "12%\n": True, "2026-01-01": False}
    got = spark.createDataFrame([(c,) for c in cells], "v string").select("v", T.matches_sweep(F.col("v"))).collect()
    assert {r[0]: r[1] for r in got} == cells


def test_scalars(spark):
    one = spark.createDataFrame([("é12%", 701)], "s string, c int")
    assert one.select(T.column_letters(F.col("c"))).first()[0] == "ZZ"
    assert scan(one.select(F.lit(1).alias("doc_id"), F.col("s").alias("text"))).first()["value"] == "12%"
    assert one.select(T.strip_fence(F.lit("```json\n[1]\n```"))).first()[0] == "[1]"
    assert one.select(documents.chunk_lines(F.split(F.lit("aa\nbbbbbb\nc\nd"), "\n"), 5)).first()[0] == [["aa"], ["bbbbbb"], ["c", "d"]]


def test_spans_merge_and_stay(spark):
    spans = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (2, 1, 2), (2, 1, 6)], "k int, s int, e int")
    once = pages.merge_spans(spans, ["k"])
    assert {tuple(r) for r in once.select("k", "s", "e").collect()} == {(1, 0, 5), (1, 7, 9), (2, 1, 6)}
    assert Counter(pages.merge_spans(once, ["k"]).collect()) == Counter(once.collect())


def test_csv(spark):
    text = '\ufeffsite;unit,bid\r\nnorth,"EUR 3,410"\r\nsouth,"say ""no"""\r\na"b,c"d,TH-204\r\n,'
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, '"open,\n')], "doc_id long, text string")
    cells = csv_spans.csv_cells(docs)
    got = [(r["r"], r["c"], r["value"]) for r in cells.where("doc_id = 1").orderBy("r", "c").collect()]
    assert got == [(0, 0, "site;unit"), (0, 1, "bid"), (1, 0, "north"), (1, 1, "EUR 3,410"), (2, 0, "south"), (2, 1, 'say "no"'), (3, 0, "ab,cd"), (3, 1, "TH-204"), (4, 0, ""), (4, 1, "")]
    assert [r["value"] for r in cells.where("doc_id = 4").collect()] == ["open,\n"] and cells.count() == 11
    masked = {r["doc_id"]: r["masked"] for r in csv_spans.mask_spans(docs, cells.where("c = 1 AND r IN (1, 3)")).collect()}
    assert masked == {1: text.replace('"EUR 3,410"', "XXXX").replace("TH-204", "XXXX"), 2: None, 3: "", 4: '"open,\n'}
    values = F.array(F.lit("TH-204"), F.lit("eur  3,410"), F.lit("s"))
    assert docs.where("doc_id = 1").select(mask.mask_csv_text(F.col("text"), values)).first()[0] == text.replace("EUR 3,410", "XXXX").replace("TH-204", "XXXX")


def plain_cells(text):
    """One character after the other."""
    rows, row, value, quoted, began, i = [], [], "", False, 0, 0
    while i < len(text):
        ch = text[i]
        if quoted:
            if ch == '"' and text[i + 1 : i + 2] == '"':
                value, i = value + '"', i + 1
            elif ch == '"':
                quoted = False
            else:
                value += ch
        elif ch == '"':
            quoted = True
        elif ch in ",\r\n":
            row.append((value, began, i))
            value = ""
            if ch != ",":
                i += text[i : i + 2] == "\r\n"
                rows.append(row)
                row = []
            began = i + 1
        else:
            value += ch
        i += 1
    return [*rows, [*row, (value, began, len(text))]] if row or began < len(text) else rows


def test_csv_cells_equal_a_plain_reader():
    draw = random.Random(2)
    for _ in range(3000):
        text = "".join(draw.choices('ab",,\r\n" ', k=draw.randrange(0, 14)))
        want = [(r, c, *cell) for r, row in enumerate(plain_cells(text)) for c, cell in enumerate(row)]
        assert list(csv_spans.cells_of(text)) == want, repr(text)


def test_rows_align_in_order(spark):
    original = [["id", "who", "bid"], ["1", "TH-204", "90"], ["2", "IDN-9", "80"], ["3", "MY-77", "70"], ["4", "", "60"]]
    copy = [["===SHEET:x==="], ["id", "who", "bid"], ["broken", "row"], ["1", "XXXX", "90"], ["3", "XXXX", "70"], ["4", "XXXX", "XXXX"]]
    flat = lambda rows: spark.createDataFrame([(1, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], "doc_id long, r int, c int, value string")
    pairs = {(r["r"], r["ro"]) for r in align.align_rows(flat(original), flat(copy)).collect()}
    assert pairs == {(0, 1), (1, 3), (3, 4), (4, 5)}  # the third row is missing in the copy
    found = {(r["r"], r["c"], r["value"], r["header"]) for r in align.copied_masks(flat(original), flat(copy)).collect()}
    assert found == {(1, 1, "TH-204", "who"), (3, 1, "MY-77", "who"), (4, 2, "60", "bid")}
    assert align.pairs_of([["a"]], [["b"]] * 40 + [["a"]], 30) == [] and align.pairs_of([["a"]], [["b"]] * 29 + [["a"]], 30) == [(0, 29)]
    assert align.align_rows(flat([]), flat(copy)).count() == 0 and align.align_rows(flat(original), flat([])).count() == 0


def test_recovered_values(spark):
    rows = [
        ("pay EUR 5 to Kali now\nnothing\nend 31%", "pay XXXX to XXXX now\nnothing\nend XXXX"), ("one two three", "one XXXXXXXX"), ("abc def", "zzz XXXX"), ("a 12 b 12 c", "a XXXX b XXXX c"),
        ("same", "same"), (None, "XXXX"), ("x", None), ("first line\nsecond", "XXXX"), ("ab cd", "XXXX cd XXXX"), ("p q r", "p XXXX gone XXXX"),
    ]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, masked string")
    found = {}
    for r in documents.recovered_values(docs).orderBy("first").collect():
        found.setdefault(r["doc_id"], []).append(r["value"])
    assert found == {0: ["EUR 5", "Kali", "31%"], 1: ["two three"], 3: ["12"], 7: ["first line"], 8: ["ab cd"], 9: ["q r"]}


def test_answers(spark):
    cases = {
        '[{"fieldName": "Price", "originalValue": "EUR 5"}]': ["EUR 5"], "[]": [], "no": None, "": None, 'so: [{"fieldName":"A","originalValue":"b]"}] ok': ["b]"], '{"all": [], "fieldName": 1}': [],
        '[{"fieldName":"A","originalValue":"b {x} \\"y\\""},{"fieldName":"C","origi': ['b {x} "y"'], '{"list":[{"fieldName":"A","originalValue":"v"}]}': ["v"], '[{"fieldName":"A"},': None,
    }
    got = spark.createDataFrame([(c,) for c in cases], "a string").select("a", answers.suggestions_of(F.col("a")).alias("s")).collect()
    assert {r["a"]: r["s"] and [x["originalValue"] for x in r["s"]] if r["s"] is not None else None for r in got} == cases
    plan = 'plan {"sheets":[{"name":"null","maskColumns":["a"," "],"maskValues":null},{"name":"B","sweepNumbers":false}]}.'
    rows = spark.createDataFrame([(plan,), ("none",)], "a string").select(answers.plan_of(F.col("a")).alias("p")).collect()
    assert [tuple(x) for x in rows[0]["p"]] == [(0, None, ["a"], [], True), (1, "B", [], [], False)] and rows[1]["p"] is None


def test_review_fields(spark):
    lines = {"a,b": ["a", "b"], "": [""], "a,": ["a", ""], ' "x, y" ,z': ["x, y", "z"], '"a""b",c': ["ab", "c"], '"open,x': ["open,x"], ",": ["", ""]}
    got = spark.createDataFrame([(k,) for k in lines], "s string").select("s", grid.review_fields(F.col("s")).alias("f"), documents.csv_fields(F.col("s")).alias("g")).collect()
    assert {r["s"]: r["f"] for r in got} == lines
    for r in got:
        assert r["g"] == [v for v, _, _ in (plain_cells(r["s"]) or [[("", 0, 0)]])[0]] or r["s"].endswith(",")
    assert next(r["g"] for r in got if r["s"] == '"a""b",c') == ['a"b', "c"]


def test_number_formats():
    for number, code, want in ((0.07, "0%", "7%"), (1234.5, "#,##0.00", "1,234.50"), (3410775, '"EUR" #,##0', "EUR 3,410,775"), (-2.5, "0.0", "-2.5"), (5, "General", "5"), (0.1, "General", "0.1"), (12, "yyyy-mm", "12"), (1e12, "General", "1e+12")):
        assert sheets.shown(number, code) == want


def book(**parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return held.getvalue()


def test_books_keep_what_they_are(spark):
    sheet = (
        '<worksheet><dimension ref="B2:D4"/><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" s="1"><v>0.31</v></c></row><row r="3"><c r="B3" t="str"><f t="shared" si="4" ref="B3:B4">A1</f><v>TH-204</v></c>'
        '<c r="C3" t="b"><v>1</v></c></row><row r="4"><c r="B4"><f t="shared" si="4"/><v>12</v></c><c r="D4" t="e"><v>#N/A</v></c></row></sheetData></worksheet>'
    )
    content = book(
        xl__workbook_dot_xml='<workbook><sheets><sheet name="Bids &amp; more" sheetId="1" r:id="rId7"/><sheet name="gone" sheetId="2" r:id="rId8"/></sheets></workbook>',
        xl___rels__workbook_dot_xml_dot_rels='<Relationships><Relationship Target="/xl/worksheets/first.xml" Id="rId7"/><Relationship Id="rId8" Target="worksheets/none.xml"/><Relationship Id="rId9" Target="calcChain.xml"/></Relationships>',
        xl__worksheets__first_dot_xml=sheet, xl__sharedStrings_dot_xml='<sst><si><r><t>two </t></r><r><t>runs</t></r></si></sst>', xl__calcChain_dot_xml="<c/>",
        xl__styles_dot_xml='<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="9"/></cellXfs></styleSheet>',
    )
    files = spark.createDataFrame([(1, bytearray(content)), (2, bytearray(b"no book")), (3, None), (4, bytearray(content[:200]))], "doc_id long, content binary")
    cells = sheets.read_cells(files)
    got = {(r["sheet"], r["r"], r["c"]): r["value"] for r in cells.collect()}
    assert got == {("Bids & more", 1, 1): "two runs", ("Bids & more", 1, 2): "31%", ("Bids & more", 2, 1): "TH-204", ("Bids & more", 2, 2): "TRUE", ("Bids & more", 3, 1): "12", ("Bids & more", 3, 3): "#N/A"}
    near = sheets.from_origin(cells)
    assert near.agg(F.min("r"), F.min("c"), F.max("r0"), F.max("c0")).first()[:] == (0, 0, 1, 1)
    targets = cells.where("value IN ('TH-204', '31%')").select("doc_id", "sheet", "r", "c", F.lit("<XXXX>").alias("put"))
    out = {r["doc_id"]: r["content"] for r in sheets.mask_books(files, targets).collect()}
    assert bytes(out[2]) == b"no book" and out[3] is None and bytes(out[4]) == content[:200]
    made = zipfile.ZipFile(io.BytesIO(bytes(out[1])))
    xml = made.read("xl/worksheets/first.xml").decode()
    assert '<c r="C2" s="1" t="inlineStr"><is><t xml:space="preserve">&lt;XXXX&gt;</t></is></c>' in xml and "shared" not in xml and '<c r="B4"><v>12</v></c>' in xml and '<dimension ref="B2:D4"/>' in xml
    assert "xl/calcChain.xml" not in made.namelist() and b"calcChain" not in made.read("xl/_rels/workbook.xml.rels")
    again = {(r["r"], r["c"]): r["value"] for r in sheets.read_cells(spark.createDataFrame([(1, bytearray(out[1]))], "doc_id long, content binary")).collect()}
    assert again[(1, 2)] == again[(2, 1)] == "<XXXX>" and again[(1, 1)] == "two runs"


def one_sheet(xml):
    return book(
        xl__workbook_dot_xml='<workbook><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        xl___rels__workbook_dot_xml_dot_rels='<Relationships><Relationship Target="worksheets/s.xml" Id="rId1"/></Relationships>', xl__worksheets__s_dot_xml=xml,
    )


def test_books_fail_closed(spark):
    """Cells without a reference or with a prefix are masked; a file in which a target can't be has no content."""
    bare = one_sheet('<worksheet><sheetData><row><c t="str"><v>a</v></c><c t="str"><v>SG-04</v></c><c r="E1"><v>x7</v></c><c t="s"><v>5</v></c></row><row r="4"><c><v>2</v></c></row><row><c t="str"><v>z</v></c></row></sheetData></worksheet>')
    prefixed = one_sheet('<x:worksheet xmlns:x="m"><x:sheetData><x:row r="2"><x:c r="A2" t="str"><x:v>SG-04</x:v></x:c><x:c r="B2"><x:v>1</x:v></x:c></x:row></x:sheetData></x:worksheet>')
    schema = "doc_id long, content binary"
    files = spark.createDataFrame([(2**53 + 1, bytearray(bare)), (2, bytearray(prefixed)), (None, bytearray(prefixed)), (3, bytearray(b"no book")), (5, bytearray(bare))], schema).coalesce(1)
    cells = sheets.read_cells(files)
    got = {(r["doc_id"], r["r"], r["c"]): r["value"] for r in cells.collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == 2**53 + 1} == {(0, 0): "a", (0, 1): "SG-04", (0, 4): "x7", (0, 5): "5", (3, 0): "2", (4, 0): "z"}
    assert got[2, 1, 0] == got[None, 1, 0] == "SG-04"
    targets = cells.where("value IN ('SG-04', 'z') AND doc_id <> 5").select("doc_id", "sheet", "r", "c", F.lit("XXXX").alias("put"))
    more = spark.createDataFrame([(3, "S", 0, 0, "XXXX"), (5, "S", 50, 50, "XXXX"), (5, "S", 0, 0, "XXXX")], "doc_id long, sheet string, r long, c long, put string")
    out = {r["doc_id"]: (r["content"], r["error"]) for r in sheets.mask_books(files, targets.unionByName(more)).collect()}
    assert out[3] == (None, "not a package") and out[5] == (None, "1 cells to mask aren't there") and out[None][1] is None
    again = sheets.read_cells(spark.createDataFrame([(k, v[0]) for k, v in out.items() if v[0] is not None], schema))
    masked = {(r["doc_id"], r["r"], r["c"]): r["value"] for r in again.collect()}
    assert masked[2**53 + 1, 0, 1] == masked[2**53 + 1, 4, 0] == masked[2, 1, 0] == "XXXX" and masked[2**53 + 1, 0, 4] == "x7" and "SG-04" not in [v for k, v in masked.items() if k[0] is not None]


def test_ids_beside_a_null(spark):
    ids = [2**53 + 1, None, -1, 3]
    texts = spark.createDataFrame([(i, "a,b") for i in ids], "doc_id long, text string").coalesce(1)
    packages = word.new_documents(texts)
    legacy = word.mask_legacy_files(packages, texts.select("doc_id", F.array("text").alias("values")))
    for made in (csv_spans.csv_cells(texts), packages, word.runs(packages), legacy):
        assert {r["doc_id"] for r in made.collect()} == set(ids)


def test_answers_of_any_depth(spark):
    """Outermost objects only, whatever is nested in them; plans hold strings only."""

    def plain(src):
        found, depth, start, inside, escaped = [], 0, -1, False, False
        for i, ch in enumerate(src):
            if inside:
                escaped, inside = (False, True) if escaped else (ch == "\\", ch != '"')
            elif ch == '"':
                inside = True
            elif ch == "{":
                start = i if depth == 0 else start
                depth += 1
            elif ch == "}":
                depth -= 1
                if depth == 0 and start >= 0:
                    found.append(src[start : i + 1])
                    start = -1
        return found

    import random

    r = random.Random(11)
    texts = ["".join(r.choices(["{", "}", '"', "\\", "a", '"b"', "{}", '{"x":{"y":1}}'], k=r.randint(0, 40))) for _ in range(300)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", answers.objects_of(F.col("t")).alias("o"))
    assert {x["i"]: x["o"] for x in got.collect()} == {i: plain(t) for i, t in enumerate(texts)}
    deep = '{"fieldName":"Price","originalValue":"USD 5","reason":{"a":{"b":{"c":{"d":{"e":"}"}}}}}}'
    some = [f"Here: {deep} and {deep.replace('USD 5', 'USD 6')}, also {{\"fieldName\":\"Price\",\"originalValue\":7}}", f"x {deep} then {{\"list\": {deep}", f"{{\"cut\": {deep}"]
    read = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "i long, t string").select("i", F.transform(answers.suggestions_of(F.col("t")), lambda s: s["originalValue"]).alias("v"))
    assert {x["i"]: x["v"] for x in read.collect()} == {0: ["USD 5", "USD 6"], 1: ["USD 5"], 2: None}
    plan = '{"sheets":[{"name":5,"maskColumns":["x",3,null,{"a":1}," "],"maskValues":[true,"v"]},{"name":"n","maskColumns":"x"}]}'
    sheets_ = spark.createDataFrame([(plan,)], "t string").select(answers.plan_of(F.col("t")).alias("p")).first()["p"]
    assert [(x["name"], x["columns"], x["values"]) for x in sheets_] == [(None, ["x"], ["v"]), ("n", [], [])]


def test_rows_of_one_table_aligned(spark):
    cells = csv_spans.csv_cells(spark.createDataFrame([(1, "a,b\nc,d\ne,f")], "doc_id long, text string"))
    assert sorted((r["r"], r["ro"]) for r in align.align_rows(cells, cells).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_word(spark):
    held = io.BytesIO()
    body = '<w:document><w:p><w:r><w:t>Bond of 2.</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>25</w:t></w:r><w:r><w:t xml:space="preserve">% &amp; a bid of </w:t></w:r><w:r><w:t>EUR 66</w:t></w:r><w:txbx><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbx><w:r><w:tab/><w:t>tail</w:t></w:r></w:p><w:p/></w:document>'
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("other.xml", "<a/>")
    broken = bytearray(held.getvalue())
    broken[60:80] = bytes(20)
    files = spark.createDataFrame([(1, bytearray(held.getvalue())), (2, bytearray(b"no package")), (3, broken), (4, None)], "doc_id long, content binary")
    runs = word.runs(files)
    assert [(r["para_no"], r["text"]) for r in runs.where("doc_id = 1").orderBy("para_no", "run_no").collect()] == [(0, "Bond of 2."), (0, "25"), (0, "% & a bid of "), (0, "EUR 66"), (0, "tail"), (1, "boxed")]
    values = spark.createDataFrame([(1, ["2.25%", "EUR 66", "25%"])], "doc_id long, values array<string>")
    out = {r["doc_id"]: r["content"] for r in word.rewrite(files, pages.run_edits(runs, pages.value_spans(runs, values))).collect()}
    made = zipfile.ZipFile(io.BytesIO(bytes(out[1])))
    xml = made.read("word/document.xml").decode()
    assert re.sub("<.*?>", "", xml) == "Bond of XXXX &amp; a bid of XXXXboxedtail" and bytes(out[2]) == b"no package" and "<w:b/>" in xml and made.read("other.xml") == b"<a/>" and out[4] is None
    texts = {r["doc_id"]: r["t"] for r in files.select("doc_id", word.document_text(F.col("content")).alias("t")).collect()}
    assert texts[1] == "Bond of 2.25% & a bid of EUR 66\ttail\n\nboxed\n\n" and texts[2] == texts[4] == ""
    made = word.new_documents(spark.createDataFrame([(1, 'a<b\nx\ty "z"\np\tq\nend'), (2, None)], "doc_id long, text string"))
    back = {r["doc_id"]: r["content"] for r in made.collect()}
    xml = zipfile.ZipFile(io.BytesIO(bytes(back[1]))).read("word/document.xml").decode()
    assert xml.count("<w:tbl>") == xml.count("</w:tbl>") == 1 and xml.count("<w:tr>") == 2 and xml.count("<w:tc>") == 4
    assert made.select(word.document_text(F.col("content"))).first()[0] == 'a<b\n\nx\n\ny "z"\n\np\n\nq\n\nend'
    data = "xTH-204y".encode("utf-16-le") + b"th-204 TH-204"
    assert word.mask_legacy(data, ["TH-204", "日本"]) == "xXXXXXXy".encode("utf-16-le") + b"XXXXXX XXXXXX"


def test_long_documents_take_no_quadratic_step(spark):
    """One document of 200,000 lines, in a time that a step for each pair of lines or hits would never meet."""
    text = "\n".join(f"line {i} of vendor TH-{i % 9000} at {i % 700},{i % 1000:03d}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert documents.chunks(docs, 4_000).agg(F.sum("n_lines")).first()[0] == 200_000
    assert documents.sections(docs).select("rows").first()[0] == 200_000
    assert scan(docs).groupBy("category").count().count() == 2
    assert time.time() - began < 120


def test_stream(spark, tmp_path):
    from cloakwork.streaming import ingest

    spark.createDataFrame([(1, TEXT)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    ingest.run_once(ingest.stream_hits(stream), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "documents", "pages", "conversations", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    found = own.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(want.columns)
    assert Counter(map(str, map(tuple, found.select(*want.columns).collect()))) == Counter(map(str, want.fetchall()))
