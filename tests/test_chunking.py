import math

from clausemill.operators import chunking, classify, layout
from clausemill.plans.ingest import ingest


def paragraph(n, start=1):
    return " ".join(f"Sentence {i} says that the borrower shall repay the amount on time." for i in range(start, start + n))


def chunks(spark, pages, **options):
    df = spark.createDataFrame([("d", p, t) for p, t in pages], "doc_id string, page int, text string")
    rows = chunking.chunk_documents(df, **options).orderBy("chunk_index").collect()
    return rows


def test_splits_on_headings(spark):
    pages = [(1, f"1. DEFINITIONS\n{paragraph(3)}\n2. THE LOAN\n{paragraph(3)}"), (2, f"3. INTEREST\n{paragraph(3)}")]
    got = chunks(spark, pages, min_tokens=10)
    assert [(c.clause_title, c.page_start, c.page_end, c.chunk_index) for c in got] == [
        ("1. DEFINITIONS", 1, 1, 0), ("2. THE LOAN", 1, 1, 1), ("3. INTEREST", 2, 2, 2),
    ]
    assert got[0].content == f"1. DEFINITIONS\n{paragraph(3)}"


def test_leading_text_has_no_title(spark):
    got = chunks(spark, [(1, f"{paragraph(3)}\n1. DEFINITIONS\n{paragraph(3)}")], min_tokens=10)
    assert [c.clause_title for c in got] == [None, "1. DEFINITIONS"]


def test_long_sections_overlap(spark):
    got = chunks(spark, [(1, f"4. COVENANTS\n{paragraph(40)}")], max_tokens=120, overlap_tokens=30, min_tokens=10)
    assert len(got) > 3
    assert all(c.token_count <= 120 + 3 and c.clause_title == "4. COVENANTS" for c in got)
    assert not got[0].content.startswith("4. COVENANTS\n") and got[1].content.startswith("4. COVENANTS\n")
    last = "Sentence" + got[0].content.split("Sentence")[-1]
    assert last.strip() in got[1].content


def test_page_range_inside_split_section(spark):
    pages = [(3, f"9. EVENTS OF DEFAULT\n{paragraph(20)}"), (4, paragraph(20, 21))]
    got = chunks(spark, pages, max_tokens=150, overlap_tokens=20, min_tokens=10)
    assert got[0].page_start == 3 and got[-1].page_end == 4
    assert any((c.page_start, c.page_end) == (3, 4) for c in got)


def test_folding_and_blank_lines(spark):
    got = chunks(spark, [(1, f"ARTICLE III - INTEREST\n3.1 Rate of Interest\n{paragraph(3)}")], min_tokens=20)
    assert [c.clause_title for c in got] == ["ARTICLE III - INTEREST > 3.1 Rate of Interest"]
    text = "\n\n1. DEFINITIONS\n\n   The   Loan  means   money.  \n\n and the rest of it "
    got = chunks(spark, [(1, text)], min_tokens=1)
    assert [c.content for c in got] == ["1. DEFINITIONS\nThe Loan means money.\nand the rest of it"]


def plain_windows(costs, head, cap, overlap):
    """Independent restatement: window ends by prefix sums, step-back by suffix sums."""
    out, s, n = [], 0, len(costs)
    while s < n:
        e = next((e for e in range(s + 1, n) if head + sum(costs[s : e + 1]) > cap), n)
        out.append((s, e - s))
        if e == n:
            return out
        options = [b for b in range(s + 1, e + 1) if sum(costs[b:e]) >= overlap]
        s = max(options) if options else s + 1
    return out


def test_windows_against_restatement():
    import random

    rng = random.Random(5)
    for _ in range(300):
        costs = [rng.randrange(2, 40) for _ in range(rng.randrange(1, 60))]
        head, cap, overlap = rng.choice([0, 7]), rng.choice([30, 60, 120]), rng.choice([0, 10, 25])
        assert chunking._windows(costs, head, cap, overlap) == plain_windows(costs, head, cap, overlap)


def test_page_limit_and_scans_are_rejected(spark):
    rows = [("long", i, "x" * 30) for i in range(61)] + [("scan", 1, " short "), ("part", 1, "y" * 30), ("part", 2, "")]
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string")
    got = {r.doc_id: (r.reject, r.warning) for r in layout.page_quality(pages).collect()}
    assert got == {
        "long": ("TOO_MANY_PAGES", None), "scan": ("SCANNED_PDF", None),
        "part": (None, "1 of 2 pages had no extractable text and were skipped."),
    }
    done = ingest(pages)
    assert {(r.doc_id, r.reject) for r in done.rejects.collect()} == {("long", "TOO_MANY_PAGES"), ("scan", "SCANNED_PDF")}
    assert [r.doc_id for r in done.documents.collect()] == ["part"]


def test_reading_order(spark):
    runs = [
        ("d", 1, 0, 300.0, 700.0, "World"), ("d", 1, 1, 100.0, 700.0, "Hello"), ("d", 1, 2, 100.0, 680.0, "Second  line"),
        ("d", 1, 3, 100.0, 701.5, ""), ("d", 1, 4, 50.0, 702.6, "Above"), ("d", 1, 5, 400.0, 702.4, "close"),
    ]
    df = spark.createDataFrame(runs, "doc_id string, page int, seq int, x double, y double, str string")
    assert [r.text for r in layout.runs_to_pages(df).collect()] == ["Above\nHello World close\nSecond line"]


def test_ingest_masks_before_chunking_and_classifies(spark):
    body = (
        "LOAN AGREEMENT TERMS\nThis agreement is made between the lender and the borrower, PAN AKLPM4821R. "
        "The borrower shall repay the loan principal with interest rate of 14% over the tenure by EMI. "
        "The processing fee and disbursement of the sanctioned loan need notice. Either party may terminate. "
        "Governing law applies, whereas prepayment of the loan is allowed."
    )
    pages = spark.createDataFrame([("d", 1, body), ("g", 1, "Lecture notes about plants and the weather of spring.")], "doc_id string, page int, text string")
    done = ingest(pages)
    kinds = {r.doc_id: r.kind for r in done.documents.collect()}
    assert kinds == {"d": "loan", "g": "general"}
    assert all("AKLPM4821R" not in r.content for r in done.chunks.collect())
    assert [(r.doc_id, r.placeholder, r.original) for r in done.pii_map.collect()] == [("d", "[PAN_1]", "AKLPM4821R")]
    again = {r.doc_id: r.content_hash for r in ingest(pages).documents.collect()}
    assert again == {r.doc_id: r.content_hash for r in done.documents.collect()}


def test_word_edges_are_ascii(spark):
    df = spark.createDataFrame([("a", "éloan loan loans")], "doc_id string, content string")
    assert df.select(*classify.signal_counts(df.content)).first().loan_0 == 2


def test_token_estimate_matches_ceiling():
    assert [chunking._tokens(n) for n in range(9)] == [math.ceil(n / 4) for n in range(9)]


def test_long_documents_are_chunked_whole(spark):
    pages = spark.createDataFrame([("d", p, f"SECTION {p}: TERMS\nThe words of page {p} are long enough to stand as one section of their own here.") for p in range(1, 101)], "doc_id string, page int, text string")
    chunks = chunking.chunk_documents(pages).collect()
    assert {c.page_start for c in chunks} == set(range(1, 101))


def test_windows_reread_the_overlap():
    assert chunking._windows([10] * 6, 0, 30, 10) == [(0, 3), (2, 3), (4, 2)]
    assert chunking._windows([50, 5, 5], 2, 20, 100) == [(0, 1), (1, 2)]
    assert chunking._windows([4], 3, 1, 0) == [(0, 1)]
