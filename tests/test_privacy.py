import pytest
from pyspark.sql import functions as F

from clausemill.operators import privacy

AADHAAR = "531872046912"
GROUPED = "5318 7204 6912"
HYPHENS = "5318-7204-6912"

POSITIVE = [
    ("holding PAN AKLPM4821R issued", [("PAN", "AKLPM4821R")]),
    ("PAN: AABCT1234F", [("PAN", "AABCT1234F")]),
    ("IFSC code HDFC0001234 of the branch", [("IFSC", "HDFC0001234")]),
    ("IFSC: SBIN0A12B34", [("IFSC", "SBIN0A12B34")]),
    (f"Aadhaar {AADHAAR}.", [("AADHAAR", AADHAAR)]),
    (f"Aadhaar number {GROUPED} is", [("AADHAAR", GROUPED)]),
    (f"UID {HYPHENS} end", [("AADHAAR", HYPHENS)]),
    ("call 9820144710 today", [("PHONE", "9820144710")]),
    ("mobile +91 98201 44710", [("PHONE", "+91 98201 44710")]),
    ("tel +91-81234-56780", [("PHONE", "+91-81234-56780")]),
    ("landline-style 09876543210", [("PHONE", "09876543210")]),
    ("write to rohan.mehra@example.co.in for", [("EMAIL", "rohan.mehra@example.co.in")]),
    ("x+loans@mail.example.com", [("EMAIL", "x+loans@mail.example.com")]),
    ("credited to account number 30412298765 held", [("ACCOUNT", "30412298765")]),
    ("A/c No. 110022334455 at", [("ACCOUNT", "110022334455")]),
    ("Acct # 5020011122233", [("ACCOUNT", "5020011122233")]),
    ("Account No: 5020 0111 2223 3", [("ACCOUNT", "5020 0111 2223 3")]),
    (
        f"Borrower PAN AKLPM4821R, Aadhaar {GROUPED}, phone 9820144710, email a@b.io, account number 30412298765, IFSC MRDN0004521.",
        [("PAN", "AKLPM4821R"), ("AADHAAR", GROUPED), ("PHONE", "9820144710"), ("EMAIL", "a@b.io"), ("ACCOUNT", "30412298765"), ("IFSC", "MRDN0004521")],
    ),
]
NEGATIVE = [
    "a sum of Rs. 5,00,000 (Rupees Five Lakh only)", "Rs. 9500000000 sanctioned", "INR 8000000000 outstanding",
    "reference 531872046913 noted", "ref 123456789012 noted", "invoice 9820144710123 issued",
    "executed on 12/03/2026 at Mumbai", "see Section 5.2 and Clause 7.3.1", "interest at 14.50% per annum",
    "code ABCDE1234F is not a PAN", "aklpm4821r", "HDFC1001234", "the figure 30412298765 appears", "5820144710",
    "user@localhost", "CIN U65999MH2010PLC123456", "GST at 18% applies", "Mumbai 400053",
]


def test_detector_tables(spark):
    rows = [(i, t) for i, t in enumerate([p[0] for p in POSITIVE] + NEGATIVE)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", "t", privacy.detect("t").alias("s"))
    got = {r.i: r for r in df.collect()}
    for i, (text, expected) in enumerate(POSITIVE):
        assert [(s.type, s.value) for s in got[i].s] == expected, text
        assert all(text[s.start : s.end] == s.value for s in got[i].s)
    for i in range(len(POSITIVE), len(rows)):
        assert got[i].s == [], got[i].t


def mask(spark, rows, seeds=None):
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string")
    if seeds is not None:
        seeds = spark.createDataFrame(seeds, "doc_id string, seed_pos int, placeholder string, original string")
    masked, placeholders, found = privacy.mask_documents(pages, seeds=seeds)
    texts = [r.text for r in masked.orderBy("doc_id", "page").collect()]
    table = {(r.doc_id, r.placeholder): r.original for r in placeholders.collect()}
    return texts, table, found


def test_numbering_within_and_across_pages(spark):
    first = "PAN AKLPM4821R, phone 9820144710, PAN AKLPM4821R again, other PAN BQRPI7734K."
    texts, table, found = mask(
        spark,
        [("a", 1, first), ("b", 1, "page one PAN AKLPM4821R"), ("b", 2, "page two PAN BQRPI7734K and PAN AKLPM4821R"), ("c", 1, "nothing")],
    )
    assert texts == [
        "PAN [PAN_1], phone [PHONE_1], PAN [PAN_1] again, other PAN [PAN_2].",
        "page one PAN [PAN_1]", "page two PAN [PAN_2] and PAN [PAN_1]", "nothing",
    ]
    assert table[("a", "[PAN_2]")] == "BQRPI7734K" and table[("a", "[PHONE_1]")] == "9820144710"
    counts = {r.doc_id: r for r in privacy.type_counts(found, ["doc_id"]).collect()}
    assert (counts["a"].pan, counts["a"].phone, counts["a"].email) == (3, 1, 0)


def test_formatting_variants_share_a_placeholder(spark):
    texts, _, _ = mask(spark, [("a", 1, f"{AADHAAR} and {GROUPED}; +91 98201 44710 and 9820144710; a@B.io and A@b.IO")])
    assert texts == ["[AADHAAR_1] and [AADHAAR_1]; [PHONE_1] and [PHONE_1]; [EMAIL_1] and [EMAIL_1]"]


def test_seeded_masking(spark):
    seeds = [("q", 0, "[PAN_1]", "AKLPM4821R"), ("q", 1, "[PHONE_3]", "9820144710"), ("q", 2, "[XYZ_1]", "zz"), ("q", 3, "[PAN_x]", "zz")]
    text = "Is AKLPM4821R the borrower and 9820144710 the number? New one: ZZZPQ9999Z"
    texts, table, _ = mask(spark, [("q", 0, text)], seeds)
    assert texts == ["Is [PAN_1] the borrower and [PHONE_3] the number? New one: [PAN_2]"]
    assert table == {("q", "[PAN_1]"): "AKLPM4821R", ("q", "[PHONE_3]"): "9820144710", ("q", "[PAN_2]"): "ZZZPQ9999Z"}


def test_same_identity_seeds_later_wins(spark):
    seeds = [("q", 0, "[PHONE_1]", "9820144710"), ("q", 1, "[PHONE_2]", "+91 98201 44710")]
    texts, _, _ = mask(spark, [("q", 0, "call 09820144710 or 8123456780")], seeds)
    assert texts == ["call [PHONE_2] or [PHONE_3]"]


def test_unmask(spark):
    rows = [
        (1, "d", "Borrower [PAN_1] can be reached at [PHONE_1]."),
        (2, "d", "The PAN_1 belongs to the borrower; XPAN_1 stays."),
        (3, "e", "nothing here [PAN_9]"),
        (4, "d", "[PAN_12] and PAN_1_x and [EMAIL_1]"),
    ]
    df = spark.createDataFrame(rows, "id int, doc_id string, text string")
    entries = [("d", 0, "[PAN_1]", "AKLPM4821R"), ("d", 1, "[PHONE_1]", "9820144710"), ("d", 2, "[EMAIL_1]", "a$1\\b@c.io")]
    pii = spark.createDataFrame(entries, "doc_id string, seed_pos int, placeholder string, original string")
    got = {r.id: r.text for r in privacy.unmask_rows(df, pii, ["doc_id"], ["id"]).collect()}
    assert got[1] == "Borrower AKLPM4821R can be reached at 9820144710."
    assert got[2] == "The AKLPM4821R belongs to the borrower; XPAN_1 stays."
    assert got[3] == "nothing here [PAN_9]"
    assert got[4] == "[PAN_12] and PAN_1_x and a$1\\b@c.io"


def test_map_summary(spark):
    rows = [("d", 0, "[PAN_1]"), ("d", 1, "[EMAIL_1]"), ("d", 2, "[PAN_2]")]
    df = spark.createDataFrame(rows, "doc_id string, seed_pos int, placeholder string")
    assert privacy.map_summary(df, ["doc_id"]).first().summary == "2 pans, 1 email"


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_against_plain_loop(spark, seed):
    import random

    rng = random.Random(seed)
    spans = []
    for _ in range(40):
        start = rng.randrange(60)
        spans.append((rng.choice(privacy.TYPES), start, start + rng.randrange(1, 9), "v"))
    df = spark.createDataFrame([(spans,)], "s " + privacy.SPAN_TYPE)
    got = [tuple(s) for s in df.select(F.expr(privacy.resolve_overlaps("s")).alias("k")).first().k]
    want, cursor = [], -1
    for s in sorted(spans, key=lambda s: (s[1], -s[2], privacy.TYPES.index(s[0]))):
        if s[1] >= cursor:
            want.append(s)
            cursor = s[2]
    assert got == want


def test_unmask_cuts_a_text_once(spark):
    """What is put back is not searched again, names without an entry stay, and many entries cost one pass."""
    pii = spark.createDataFrame([("d", n, f"[PAN_{n}]", f"<{n}>") for n in range(1, 301)] + [("d", 400, "[EMAIL_1]", "[PAN_2] $1 \\\\ PAN_3")], "doc_id string, seed_pos int, placeholder string, original string")
    text = " ".join(f"[PAN_{n}] PAN_{n}, XPAN_{n} PAN_{n}0000 [PAN_{n}]x" for n in range(1, 301)) + " [EMAIL_1] [EMAIL_2] [PAN_4"
    df = spark.createDataFrame([("d", 1, text), ("d", 2, "nothing here"), ("d", 3, None), ("d", 4, "")], "doc_id string, id int, text string")
    got = {r.id: r.text for r in privacy.unmask_rows(df, pii, ["doc_id"], ["id"]).collect()}
    first = " ".join(f"<{n}> <{n}>, XPAN_{n} PAN_{n}0000 <{n}>x" for n in range(1, 301))
    assert got == {1: first + " [PAN_2] $1 \\\\ PAN_3 [EMAIL_2] [<4>", 2: "nothing here", 3: None, 4: ""}


def test_masked_notes_are_written_before_they_are_put_back(spark, monkeypatch):
    """Both the search for placeholders and the texts that get them back read masked notes, which are made once."""
    from catalog import QUERIES

    held = []
    put_back = privacy.unmask_rows
    monkeypatch.setattr(privacy, "unmask_rows", lambda rows, pii, *a: held.extend([rows, pii]) or put_back(rows, pii, *a))
    assert QUERIES["unmasked_m15"](spark, "/root/testdata/sf0.001").count() > 0
    for table in held:
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "Exchange" not in plan and "Window" not in plan


def test_kept_masks_are_those_that_are_not(spark):
    rows = [(1, 1, "PAN ABCPA1234B"), (1, 2, "a@b.com, ABCPA1234B"), (2, 1, None), (2, 1, "PAN ABCPA1234B"), (None, 1, "a@b.com")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    for one, other in zip(privacy.mask_documents(pages), privacy.mask_documents(pages, kept=True)):
        assert one.columns == other.columns and sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
