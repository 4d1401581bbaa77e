"""Queries over whole texts, against the rules written out once more in plain Python."""

import hashlib
import re

import pytest
from conftest import SMALL

from archivolt.operators import extract as E
from archivolt.plans import QUERIES


def rule(text):
    """E9 (doc_type, confidence) of one text whose pages are parted by form feeds."""
    pages = (text or "").split("\f")
    first, full, n = pages[0], "\n".join(pages), len(pages)
    has = lambda p, t=full: re.search("(?im)" + p, t, re.A) is not None
    if n == 1 and has(r"\bB[l1i]ock\W{0,4}\d+\W{1,4}L[o0][tl1i]\W{0,4}\d+", first):
        return "cover_sheet", 0.9 if has(r"\bBIN\s*[:\-]?\s*\d{6,7}", first) else 0.55
    for name, confidence, p in E.DOC_TYPES:
        if has(p.removeprefix("(?i)")):
            return name, confidence
    hits = sum(map(has, E.LAB_SIGNS))
    if E.lab_structure(full) or hits:
        return "lab_report", 0.8 if E.lab_structure(full) else 0.65 if hits > 1 else 0.45
    head = {k: has(rf"^\s*{k}", first) for k in ("From\\s*:", "To\\s*:", "Re\\s*:", "Dear\\s+\\S")}
    sender, to, re_, dear = head.values()
    if sender or to or re_ or dear:
        return "memo_letter", 0.75 if (sender and to) or dear else 0.6 if re_ and (sender or to) else 0.45
    if has(r"\bphoto(?:graph)?\s*log\b|\blist\s*of\s*photographs?\b|\bphoto\s*index\b"):
        return "photo_log", 0.6
    if len(re.findall(r"[❑□☐]|\[\s?\]", full)) >= 3 or len(re.findall(r"(?m)^\s*\d{1,2}\.\s+[A-Z]", full)) >= 4:
        return "form", 0.4
    return "other", 0.0


LONG = "plain words without a marker " * 40
TEXTS = {
    1: (LONG + "\nInvoice no. 12", ("invoice", 0.7)), 2: (LONG + "chain of custody", ("chain_of_custody", 0.85)), 3: (LONG + "\fTo: B", ("other", 0.0)),
    4: (LONG + "\nFrom: A\nTo: B\f" + LONG, ("memo_letter", 0.75)), 5: (LONG + "Block 38 Lot 17", ("cover_sheet", 0.55)), 6: ("Block 38 Lot 17\fmore", ("other", 0.0)),
    7: (LONG + "\fLaboratory Results\nLab ID: 3\nDate of analysis: x", ("lab_report", 0.8)), 8: (None, ("other", 0.0)), 9: (LONG, ("other", 0.0)),
}


def test_types_see_whole_texts(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, (t, _) in TEXTS.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["doc_type"], r["confidence"]) for r in QUERIES["whole_text_types"](spark, str(tmp_path)).collect()}
    assert got == {i: want for i, (_, want) in TEXTS.items()} == {i: rule(t) for i, (t, _) in TEXTS.items()}


SHEET = "TEM Asbestos (air) Count Sheet\nGrid Opening 3\nLab Group: 2\nf/cc"
REASONS = {
    1: (SHEET, "lab_count_sheet", "TEM asbestos count sheet heading with grid/filter/lab-group fields"),
    2: (SHEET + "\f2", "lab_count_sheet", "TEM asbestos count sheet heading with grid/filter/lab-group fields"),
    3: (SHEET + "\f2\f3", "lab_report", "analytical-report signals: f/cc or fibers/cc"),
    4: (SHEET.replace("Lab Group", "Grid Box"), "lab_report", "analytical-report signals: f/cc or fibers/cc"),
    5: ("Amount\ndue", "invoice", "invoice header vocabulary ('Amount\\ndue')"),
    6: ("Laboratory Results\nLab ID: 3\nDate of analysis: x", "lab_report", "lab report heading with labelled fields: laboratory ID, analysis date"),
    7: ("NYC 9/11 Public Portal Document To: B", "memo_letter", "a single From:/To:/Re:/Dear header line"),
    8: ("[ ] [] \u2610", "form", "structured form heuristic: 3 checkbox marks, 0 numbered fields"), 9: ("x", "other", "no rule matched"),
}


def test_count_sheets_reasons_and_the_watermark(spark, tmp_path):
    spark.createDataFrame([(i, x[0]) for i, x in REASONS.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["doc_type"], r["reason"]) for r in QUERIES["whole_text_types"](spark, str(tmp_path)).collect()}
    assert got == {i: x[1:] for i, x in REASONS.items()}


@pytest.mark.parametrize("d", [SMALL, SMALL.replace("sf0.001", "sf0.01")])
def test_types_as_by_brute_force(spark, d):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["doc_type"], r["confidence"]) for r in QUERIES["whole_text_types"](spark, d).collect()}
    assert got == {i: rule(t) for i, t in texts.items()}


def test_selection_as_by_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    label = {r["doc_id"]: r["quality"] == 1 for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    page = {r["page_id"]: r["text"] or "" for r in QUERIES["html_text"](spark, SMALL).collect()}
    size = lambda t: len(re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip())
    want = {}
    for i, t in texts.items():
        other = page.get(i, "")
        ours = label.get(i, size(t) < 80 <= size(other))
        want[i] = (ours, hashlib.md5((other if ours else t).encode()).hexdigest())
    assert {r["doc_id"]: (r["ours"], r["digest"]) for r in QUERIES["whole_text_selection"](spark, SMALL).collect()} == want
    assert len(set(label.values())) == 2 and any(i in page for i in texts) and any(i not in label for i in texts)
