import corpus_pipeline
from pyspark.sql import functions as F

from clausemill.llm.language import fit, identify

from test_decontamination import brute as leaks_of
from test_line_dedup import brute as groups_of
from test_near_dedup import brute as near_of

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]

    def kept(name, df):
        out = steps[name](spark, df, FOLDER)
        assert name == "bpe" or out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    known = kept("language_id", docs)
    found = {r["doc_id"]: r for r in identify(docs, fit(docs), ["doc_id"]).collect()}
    assert {d for d, _ in pairs(known)} == {d for d, r in found.items() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert known.count() >= 0.95 * docs.count()

    lines = kept("line_dedup", known)
    before = pairs(known)
    first, _ = groups_of(before)
    expected = {}
    for d, text in before:
        rest = "\n".join(x for n, x in enumerate(text.split("\n")) if first.get((d, n), (d, n)) == (d, n))
        if rest.strip():
            expected[d] = rest
    got = dict(pairs(lines))
    assert set(got) == set(expected)
    assert sum(got[d] != expected[d] for d in got) <= 0.01 * len(got)  # the bands' recall
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = kept("near_dedup", lines)
    groups, _ = near_of(pairs(lines), 5)
    assert {d for d, _ in pairs(near)} == {d for d, (_, root) in groups.items() if root == d}

    clean = kept("decontamination", near)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaky = {d for d, _ in leaks_of(pairs(near), items)}
    assert leaky and {d for d, _ in pairs(clean)} == {d for d, _ in pairs(near)} - leaky

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.vocabulary_path("word_bpe_49k.json"))
    texts = dict(pairs(clean))
    rows = kept("bpe", clean).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert memoryview(bytes(r["ids"])).cast("I").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"] and out.count() > 0


EDGES = [
    (None, "A row without a key that has words enough to be kept in the end.", "en", "s", 1, "x"), (900, None, None, None, None, None), (901, "", "en", "s", 0, "y"),
    (902, " \n\t ", None, "s", 4, "z"), (903, "Repeated row of the table with some words in it.", "en", None, 9, "w"),
    (903, "Repeated row of the table with some words in it.", "en", None, 9, "w"), (904, "word " * 60000, "en", "s", 300000, "v"),
]


def test_every_stage_on_odd_rows_and_empty_tables(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    odd = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long, ids string").repartition(3)
    docs = given.withColumn("ids", F.lit("own")).unionByName(odd)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        last = name == "bpe"
        assert out.columns == (["doc_id", "lang", "source", "n_tokens", "ids", "decoded"] if last else docs.columns)
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        rows = out.collect()
        kept[name] = sorted((r["doc_id"] for r in rows), key=repr)
        assert last or all(r["ids"] in ("own", "x", "y", "z", "w", "v", None) for r in rows)
    ids = {name: set(found) for name, found in kept.items()}
    assert not ids["language_id"] & {900, 901, 902} and ids["line_dedup"] & {900, 901, 902} == {902}
    assert {900, 901, 902} <= ids["near_dedup"] & ids["decontamination"] & ids["bpe"]
    assert kept["near_dedup"].count(903) == 1 and kept["bpe"].count(903) == 2 and kept["line_dedup"].count(903) == 2
    assert None in ids["near_dedup"] and None in ids["bpe"]


def test_the_last_stage_needs_no_other_columns(spark):
    docs = spark.createDataFrame([(1, "Some words"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: (r["n_tokens"], r["decoded"]) for r in corpus_pipeline.bpe(spark, docs, FOLDER).collect()}
    assert rows[1][0] == 2 and rows[2] == (0, "")
