"""The statement flow: the row scan against a plain sequential scan, layouts as files, refusals, encodings, SQL."""

import random
import re
import zipfile
from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from proofrecon.operators.statements import mappings_of, parsed_rows, read_flow, scanned_rows
from proofrecon.operators.tables import find_header
from proofrecon.plans.rendered import LAYOUTS
from proofrecon.sources.statements import decode, read_statements, register, without_spacers

CELLS = "file string, line long, cells array<string>"
ROLES = ("date", "time", "reference", "debit", "credit", "amount", "direction", "balance")
NAMES = ["Date", "Narration", "Ref", "Debit", "Credit", "Balance"]
RNG = random.Random(7)

# ---------------------------------------------------------------- the scan

TEXTS = ["UPI/123456", "IMPS-77 Asha", "more text", "Chq: 99", "Chq no: 5", "tail 12", "34 head", ""]
DATES = ["01/02/2026", "", "", "", "13/02/2026", "rubbish"]
MONEY = ["10.00", "", "", "0.00", "x.y"]
WHOLE = [
    ["", "Total", "", "5.00", "", ""], ["", "Page 1 of 2", "", "", "", ""], NAMES, ["", "Opening balance", "", "", "", "100.00"], ["01/02/2026", "Closing balance", "", "", "", "7.00"], ["", "", "", "", "", ""],
    ["", "*** end ***", "", "", "", ""], ["", "Balance b/f", "", "", "", "3.00"],
]


def sequential(rows):
    """Kinds and whole transactions by one pass with plain state."""
    kinds, made, pending, footer, closed, last, opening = {}, [], [], False, False, None, None
    glue = lambda a, b: a + b if a[-1:].isdigit() and b[:1].isdigit() else f"{a} {b}".strip()
    money = lambda s: abs(Decimal(s)) if re.fullmatch(r"\d+\.\d+", s) else None
    for line, cells in rows:
        date, text, ref, debit, credit, balance = cells
        whole = " ".join(c for c in cells if c)
        d, c, b = money(debit), money(credit), money(balance)
        dt = datetime.strptime(date, "%d/%m/%Y") if re.fullmatch(r"\d\d/\d\d/\d{4}", date) else None
        if not whole:
            continue
        if [x.lower() for x in cells] == [x.lower() for x in NAMES]:
            kinds[line] = "repeated_header"
        elif b is not None and d is None and c is None and re.search(r"(?i)\b(opening\s+balance|balance b/f)\b", whole):
            kinds[line], opening = "opening", b if opening is None else opening
        elif dt is None:
            if footer or re.search(r"Page \d+ of", whole):
                kinds[line] = "footer_text"
            elif re.search(r"(?i)\btotal\b|closing balance|\*{3,}", whole):
                kinds[line], footer = "footer", True
            elif text and d is None and c is None and b is None:
                if re.match(r"(UPI|IMPS)[/-]", text):
                    kinds[line], pending = "above", [text]
                elif pending:
                    kinds[line] = "above"
                    pending.append(text)
                elif last and not closed:
                    kinds[line] = "below"
                    last["text"] = glue(last["text"], text)
                    last["ref"] = last["ref"] or ref
                    closed = bool(re.match(r"Chq\.?\s*(no)?:", text))
                else:
                    kinds[line] = "between" if last else "no_date"
            else:
                kinds[line] = "lost" if d is not None or c is not None else "no_date"
        elif d is None and c is None:
            bad = any(x and money(x) is None for x in (debit, credit, balance))
            kinds[line] = "lost" if bad else "closing_balance" if b is not None and "Closing balance" in whole else "no_amount"
        else:
            kinds[line] = "transaction"
            for p in reversed(pending):
                text = glue(p, text)
            d, c = (None if d == 0 and c else d), (None if c == 0 and d else c)
            last, pending, footer, closed = {"line": line, "text": text, "ref": ref, "debit": d, "credit": c, "balance": b}, [], False, False
            made.append(last)
    return kinds, made, opening


def statement(n):
    rows = []
    for line in range(1, n):
        if RNG.random() < 0.15:
            rows.append((line, RNG.choice(WHOLE)))
        else:
            rows.append((line, [RNG.choice(DATES), RNG.choice(TEXTS), RNG.choice(["", "", "123456789012"]), RNG.choice(MONEY), RNG.choice(MONEY), RNG.choice(["", "", "50.00"])]))
    return rows


def test_scan_equals_a_sequential_scan(spark):
    files = {f"f{k}": statement(60) for k in range(25)}
    cells = spark.createDataFrame([(f, line, cells) for f, rows in files.items() for line, cells in rows], CELLS)
    roles = {"date": 0, "time": None, "reference": 2, "debit": 3, "credit": 4, "amount": None, "direction": None, "balance": 5}
    mapping = spark.createDataFrame([(f,) for f in files], "file string").select(
        "file", F.lit("told").alias("candidate"), F.lit(0).cast("long").alias("data_from"), F.array(*map(F.lit, NAMES)).alias("names"), F.lit(False).alias("synthesized"),
        *(F.lit(v).cast("int").alias(r) for r, v in roles.items()), F.array(F.lit(1)).alias("narration"), F.lit("dmy").alias("date_order"),
    )
    kinds = {(r["file"], r["line"]): r["kind"] for r in scanned_rows(cells, mapping).collect()}
    parsed = parsed_rows(cells, mapping).collect()
    got = {(r["file"], r["t"]["line"]): (r["narration"], r["ref_text"] or "", r["t"]["debit"], r["t"]["credit"], r["t"]["balance"]) for r in parsed if r["t"]}
    openings = {}
    for r in parsed:
        if r["_opening"]:
            openings[r["file"]] = r["_opening"]["balance"]
    want_kinds, want = {}, {}
    for f, rows in files.items():
        k, made, opening = sequential(rows)
        want_kinds |= {(f, line): kind for line, kind in k.items()}
        want |= {(f, t["line"]): (t["text"], t["ref"], t["debit"], t["credit"], t["balance"]) for t in made}
        assert openings.get(f) == opening
    assert kinds == want_kinds
    assert got == want
    assert set(Counter(kinds.values())) >= {"transaction", "above", "below", "between", "footer", "footer_text", "lost", "opening", "repeated_header", "no_amount", "no_date"}


# ---------------------------------------------------------------- whole files


TRUTH = [(datetime(2026, 1, d, 9 + d % 8, d, 0), f"UPI/10000000{d:04d}/Asha Rao/asha@ybl", (None, Decimal(100 * d)) if d % 3 else (Decimal("10.50"), None), f"10000000{d:04d}") for d in range(1, 29)]


def written(head, row, first=()):
    balance, out = Decimal(50_000), [list(r) for r in first] + ([head] if head else [])
    for k, (dt, text, (debit, credit), ref) in enumerate(TRUTH):
        balance += (credit or 0) - (debit or 0)
        out += row(k, dt, text, debit, credit, balance, ref)
    return out


def csv_bytes(rows, sep=",", encoding="utf-8"):
    return "\r\n".join(sep.join(f'"{c}"' if sep in c or '"' in c else c for c in r) for r in rows).encode(encoding)


def workbook(path, rows):
    letters = "ABCDEFGH"

    def cell(j, k, value):
        if isinstance(value, datetime):
            days = (value - datetime(1899, 12, 30)).total_seconds() / 86_400
            return f'<c r="{letters[j]}{k}" s="1"><v>{days!r}</v></c>'
        if isinstance(value, Decimal):
            return f'<c r="{letters[j]}{k}"><v>{float(value)!r}</v></c>'
        return f'<c r="{letters[j]}{k}" t="inlineStr"><is><t>{value}</t></is></c>' if value else ""

    def sheet(rows):
        body = "".join(f'<row r="{k}">' + "".join(cell(j, k, c) for j, c in enumerate(r)) + "</row>" for k, r in enumerate(rows, 1))
        return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'

    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="old" sheetId="1" state="hidden" r:id="r1"/><sheet name="new" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet([["01/01/2026", "hidden", Decimal(1), Decimal(2), Decimal(3)]] * 90))
        z.writestr("xl/worksheets/sheet2.xml", sheet(rows))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("statements")
    text = lambda x: "" if x is None else str(x)
    five = ["Date", "Narration", "Debit", "Credit", "Balance"]
    stamp = lambda dt: dt.strftime("%d/%m/%Y %H:%M")
    plain = lambda k, dt, t, d, c, b, r: [[stamp(dt), t, text(d), text(c), text(b)]]
    comma = lambda x: "" if x is None else f"{x:,.2f}".translate(str.maketrans(",.", ".,"))
    files = {
        "standard.csv": csv_bytes(written([*five[:2], "Chq/Ref No", *five[2:]], lambda k, dt, t, d, c, b, r: [[stamp(dt), t, r, text(d), text(c), text(b)]])),
        "marked.csv": csv_bytes(written(["Date", "Description", "Amount", "Balance"], lambda k, dt, t, d, c, b, r: [[stamp(dt), t, f"{d or c:,} {'Dr' if d else 'Cr'}", f"{b:,}"]])),
        "signed.csv": csv_bytes(written(["Txn Date", "Details", "Amount", "Running Balance"], lambda k, dt, t, d, c, b, r: [[stamp(dt), t, f"-{d}" if d else str(c), text(b)]])),
        "timed.csv": csv_bytes(written(["Date", "Time", "Particulars", *five[2:]], lambda k, dt, t, d, c, b, r: [[dt.strftime("%d-%b-%Y"), dt.strftime("%H:%M"), t, text(d), text(c), text(b)]]), encoding="utf-16"),
        "currency.csv": csv_bytes(written(five, lambda k, dt, t, d, c, b, r: [[stamp(dt), t, f"₹{d}" if d else "", f"₹{c}" if c else "", f"₹ {b:,}"]]), encoding="utf-8-sig"),
        "junk.csv": csv_bytes([["A bank"], ["Account", "1"], [], *written(five, plain), ["", "Total", "9", "9", ""], ["", "after", "", "", ""], ["Page 1 of 1"]]),
        "wrapped.csv": csv_bytes(written(five, lambda k, dt, t, d, c, b, r: [[stamp(dt), t[:10], text(d), text(c), text(b)], ["", t[10:], "", "", ""]])),
        "decimal.txt": csv_bytes(written(five, lambda k, dt, t, d, c, b, r: [[stamp(dt), t + " – é", comma(d), comma(c), comma(b)]]), ";", "cp1252"),
        "newest.csv": csv_bytes((lambda x: [x[0], *x[:0:-1]])(written(["Date", "Narration", "Amount", "Type", "Balance"], lambda k, dt, t, d, c, b, r: [[stamp(dt), t, text(d or c), "DEBIT" if d else "CREDIT", text(b)]]))),
        "inverted.csv": csv_bytes(written(["Txn Date", "Details", "Amount", "Balance"], lambda k, dt, t, d, c, b, r: [[stamp(dt), t, str(d) if d else f"-{c}", text(b)]])),
        "no_balance.csv": csv_bytes(written(five[:4], lambda k, dt, t, d, c, b, r: [[stamp(dt), t, text(d), text(c)]])),
        "no_header.csv": csv_bytes(written(None, plain)),
        "tabs.tsv": csv_bytes(written(five, plain), "\t", "utf-32"),
        "above.csv": csv_bytes(written(five, lambda k, dt, t, d, c, b, r: [["", t[:8], "", "", ""], ["", t[8:], "", "", ""], [stamp(dt), "", text(d), text(c), text(b)], ["", f"Chq: {r}", "", "", ""]])),
    }
    for name, data in files.items():
        (at / name).write_bytes(data)
    workbook(at / "sheets.xlsx", written(["Date", "Narration", "", "Debit", "Credit", "Balance"], lambda k, dt, t, d, c, b, r: [[dt, t, "", d, c, b]]))
    (at / "a.pdf").write_bytes(b"%PDF-1.4")
    (at / "b.xls").write_bytes(b"\xd0\xcf\x11\xe0 old")
    (at / "c.xlsx").write_bytes(b"PK\x03\x04 broken")
    (at / "d.csv").write_bytes(b" \n ")
    (at / "e.csv").write_bytes(b"just,words\nin,here\n")
    return at


def test_files_to_rows(spark, folder):
    raw = read_statements(spark, str(folder))
    bad = {r["file"].rsplit("/", 1)[1]: r["error"] for r in raw.where("error is not null").collect()}
    assert bad == {"a.pdf": "unsupported", "b.xls": "old_workbook", "c.xlsx": "unreadable", "d.csv": "empty"}
    flow = read_flow(without_spacers(raw.where("error is null").select("file", "line", "cells")))
    assert [(r["file"].rsplit("/", 1)[1], r["error"]) for r in flow.errors.collect()] == [("e.csv", "no_transactions")]
    rows = {}
    for r in flow.rows.orderBy("file", "place").collect():
        rows.setdefault(r["file"].rsplit("/", 1)[1], []).append(r)
    assert len(rows) == 15
    balance, levels = Decimal(50_000), []
    for _, _, (d, c), _ in TRUTH:
        balance += (c or 0) - (d or 0)
        levels.append(balance)
    for name, got in rows.items():
        assert [(r["dt"], r["debit"], r["credit"], r["ref"]) for r in got] == [(dt, d, c, ref) for dt, _, (d, c), ref in TRUTH], name
        assert [r["balance"] for r in got] == ([None] * 28 if name == "no_balance.csv" else levels), name
        assert {r["name_hint"] for r in got} == {"Asha Rao"}, name
        assert all(r["narration"].startswith(t) for r, (_, t, *_) in zip(got, TRUTH, strict=True)), name
    meta = {r["file"].rsplit("/", 1)[1]: r for r in flow.meta.collect()}
    assert {n: m["status"] for n, m in meta.items() if m["status"] != "pass"} == {"no_balance.csv": "unavailable"}
    assert [n for n, m in meta.items() if m["flipped"]] == ["inverted.csv"] and [n for n, m in meta.items() if m["newest_first"]] == ["newest.csv"]
    assert [n for n, m in meta.items() if m["synthesized"]] == ["no_header.csv"] and meta["no_header.csv"]["parse_confidence"] == 0.87
    assert meta["standard.csv"]["parse_confidence"] == 0.97 and "no_balance" in meta["no_balance.csv"]["warnings"] and meta["no_balance.csv"]["needs_confirmation"]
    assert meta["junk.csv"]["n_skipped"] == 3 and meta["above.csv"]["n_stitched"] == 84


def test_given_mapping_and_lost_rows(spark):
    made = [["Date", "A", "B", "C"], ["05/06/2026", "UPI/a", "5.00", "105.00"], ["06/06/2026", "UPI/b", "?", "1"], ["07/06/2026", "UPI/c", "7.00", "112.00"], ["99/99/2026", "UPI/d", "3.00", "1.00"]]
    cells = spark.createDataFrame([(f, n, c) for f in ("x", "y") for n, c in enumerate(made, 1)], CELLS)
    user = spark.createDataFrame([("x", "user", 0, 2, 3, [1], "mdy")], "file string, source string, date int, debit int, balance int, narration array<int>, date_order string")
    given = user.select("file", "source", *(F.col(r) if r in user.columns else F.lit(None).cast("int").alias(r) for r in ROLES), "narration", "date_order")
    meta = {r["file"]: r for r in read_flow(cells, given).meta.collect()}
    assert meta["x"]["candidate"].startswith("user") and not meta["x"]["flipped"] and meta["x"]["order"] == "mdy" and meta["x"]["status"] == "fail"
    assert meta["x"]["first_break"]["hint"] == "exchanged" and meta["x"]["n_lost"] == 2
    assert meta["y"]["candidate"] == "told" and meta["y"]["status"] == "pass" and [r["line"] for r in meta["y"]["lost"]] == [3, 5]


def test_empty(spark):
    flow = read_flow(spark.createDataFrame([], CELLS))
    assert flow.rows.count() == flow.meta.count() == flow.errors.count() == 0


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-32", "cp1252", "cp1251", "cp1253", "shift_jis"])
def test_encodings(encoding):
    words = {"cp1251": "Дата,Назначение платежа\n01.02.2026,Оплата за услуги Иванов", "cp1253": "Ημερομηνία,Περιγραφή\n01/02/2026,Κατάθεση μετρητών", "shift_jis": "日付,摘要\n2026/01/02,振込 ヤマダ タロウ"}
    text = words.get(encoding, "Date,Narration\n01/02/2026,Café Zoë naïve façade")
    assert decode(text.encode(encoding)) == text


def test_sql_alone(spark, folder):
    """From bytes to a count of cells by SQL only."""
    register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW statement_files AS SELECT * FROM binaryFile.`{folder}/standard.csv`")
    n = spark.sql("SELECT count(*) AS n, max(size(c.cells)) AS width FROM statement_files f, LATERAL statement_cells(f.content) c WHERE c.error IS NULL").first()
    assert tuple(n) == (29, 6)
    pasted = spark.sql("SELECT c.* FROM pasted_cells('Date  Narration  Credit\\n01/02/2026  UPI/x  5.00') c").collect()
    assert [r["cells"] for r in pasted] == [["Date", "Narration", "Credit"], ["01/02/2026", "UPI/x", "5.00"]]


def test_layout_names():
    assert len(LAYOUTS) == 14


def test_header_choice(spark):
    made = {
        "first": [["Bank", "of", "X"], ["Date", "Narration", "Credit"], ["01/02/2026", "a", "5.00"], ["Date", "Narration", "Credit"], ["02/02/2026", "b", "6.00"]],
        "none": [["01/02/2026", "a", "5.00"], ["02/02/2026", "b", "6.00"]],
        "weak": [["x", "y", "z"], ["just", "some", "words"], ["01/02/2026", "a", "5.00"]],
        "void": [["x", "y", "z"]],
    }
    cells = spark.createDataFrame([(f, n, c) for f, rows in made.items() for n, c in enumerate(rows, 1)], CELLS)
    got = {r["file"]: (r["header_line"], r["data_from"], r["synthesized"]) for r in find_header(cells).collect()}
    assert got == {"first": (2, 3, False), "none": (None, 1, True), "weak": (None, 3, True)}
    assert mappings_of(cells, find_header(cells)).where("file = 'none'").first()["amount"] == 2
