"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, an empty table and clashing columns."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import licenses, lines, lm, mixing, neardup, packing, phrases, quality, resampling, secrets, substrings, suffixes
from quarry.llm.common import delete, names, scratch, stored

LONG = "Some words of a very long text, over and over again.\n" * 4000
ROWS = [(None, None, None), (None, "a b c d e f", "s"), (1, "", "s"), (2, " \t\n", None), (3, LONG, "s"), (4, LONG, "t"), (4, LONG, "t"), (5, "one two three", "t"), (6, "one two three", "t"), (2, "another text under a used id", "u")]
CLASH = ["_key", "_hash", "_doc", "_drop", "_lines", "_words", "_kept", "_row", "_ranges", "_cut", "_h", "_bucket", "_run", "_size", "_finish", "_text", "_train", "size", "target", "source_size", "finish", "taken", "n_lines", "kept_text", "n_words", "cleaned", "kept", "component_id", "part", "ids", "score", "lang", "n_chars"]
NEW = {
    "lines": ["n_lines", "n_dropped", "kept_text"], "substrings": ["n_words", "n_removed", "kept_text"], "mixing": ["size", "source_size", "target", "finish", "served", "taken"],
    "resampling": ["n_words", "n_features", "weight", "score"], "suffixes": ["n_bytes", "n_removed", "n_spans", "spans", "kept_bytes"],
    "quality": ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "cleaned", "kept"],
}
OPERATORS = {
    "lines": lines.line_dedup, "substrings": substrings.substring_dedup, "mixing": mixing.mix_sources, "mixed": mixing.mixed_documents, "quality": quality.quality_rules, "secrets": secrets.secret_scan,
    "licenses": licenses.license_scan, "lm": lm.score_documents, "near": neardup.near_duplicates, "packing": lambda d: packing.pack(d, tokenizer=packing.tokenizer_path(), keep_ids=False),
    "resampling": lambda d: resampling.importance_scores(d, d.select("text")), "suffixes": suffixes.suffix_dedup,
}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(f"user {c}") for c in CLASH}).cache()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator_on_odd_rows(docs, name):
    out = OPERATORS[name](docs)
    rows = out.collect()
    assert OPERATORS[name](docs.limit(0)).count() == 0
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    if name in ("packing",):
        assert sorted(r.doc_id for r in rows if r.start == 0 and r.doc_id is not None) == [1, 2, 2, 3, 4, 4, 5, 6]
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    elif name == "mixed":
        assert out.columns == docs.columns and {r.doc_id for r in rows} <= {r[0] for r in ROWS} and rows
    else:
        assert sorted((r.doc_id or 0) for r in rows) == sorted(r[0] or 0 for r in ROWS)
    if name in NEW or name == "mixed":
        for c in set(CLASH) - set(NEW.get(name, [])):
            assert all(r[c] == f"user {c}" for r in rows), c
        assert {(r.doc_id, r.text) for r in rows} <= {r[:2] for r in ROWS}


def test_stages_on_odd_rows(spark, docs):
    import corpus_pipeline as c

    for name, stage in c.STAGES:
        out = stage(spark, docs, "")
        rows = out.collect()
        assert stage(spark, docs.limit(0), "").count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r[x] == f"user {x}" for r in rows for x in CLASH if x != "n_chars"), name
    texts = {r.text for r in c.lines(spark, docs, "").collect()}
    assert "one two three" in texts and not any(t is None or not t.strip() for t in texts)


def test_scratch_goes_with_its_scope_and_kept_tables_with_the_one_around(spark):
    df, left = spark.range(5).withColumn("x", F.lit(1)), set()
    with scratch(spark, left) as keep:
        a, b = stored(df, "a"), stored(df, "b")
        with scratch(spark) as inner:
            c, d = stored(df, "c"), stored(df, "d", by="id")
            inner(c)
        keep(a, c)
    assert a.count() == c.count() == 5 and len(left) == 2 and left <= names(a) | names(c)
    for gone in (b, d):
        with pytest.raises(Exception, match="NOT_EXIST|does not exist|PATH_NOT_FOUND"):
            gone.collect()
    delete(spark, left)


def test_line_runs_add_up_over_compactions(spark):
    runs, schema = lines.LineRuns(spark, 10), "h1 long, h2 long, n long"
    for _ in range(7):  # in each batch 3 documents of key 1 and 1 of every other key
        runs.add(spark.createDataFrame([(k, -k, 3 if k == 1 else 1) for k in range(1, 400)], schema))
    assert [len(level) for level in runs.levels] == [1, 2]
    assert all(spark.table(name).groupBy("h1").count().where("count > 1").isEmpty() for name in runs.runs())
    asked = runs.totals(spark.createDataFrame([(1, -1, 1), (2, -2, 1), (999, 0, 1)], schema))
    assert {r.h1: r.before for r in asked.collect()} == {1: 12, 2: 7, 999: 0}  # key 1 is settled after four batches
    assert [tuple(r) for r in runs.close().collect()] == [(1, -1)]


def test_line_runs_of_nothing(spark):
    runs, none = lines.LineRuns(spark, 10), spark.createDataFrame([], "h1 long, h2 long, n long")
    for _ in range(4):
        runs.add(none)
    assert runs.close().count() == 0


def test_new_operators_on_odd_rows(docs):
    """Repeated rows and copies lose all of a long text; texts below the window lose nothing."""
    rows = suffixes.suffix_dedup(docs).collect()
    assert sorted((r.doc_id, r.n_removed == r.n_bytes) for r in rows if r.text == LONG) == [(3, True), (4, True), (4, True)]
    assert all(r.n_removed == 0 and bytes(r.kept_bytes).decode() == (r.text or "") for r in rows if r.text != LONG)
    drawn = resampling.importance_resample(docs, docs.select("text"), percent=100).collect()
    assert sorted(r.rank for r in drawn if r.rank) == [1, 2, 3] and len(drawn) == len(ROWS)
    found = phrases.collocations(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang for r in found} == {"und"} and all(r.a >= 30 for r in found) and "some words of a" in {r.phrase for r in found}
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_packing_from_a_folder_without_the_package(tmp_path):
    """Workers that can't import the package: the driver finds it by sys.path alone."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(packing.__file__).resolve().parents[2])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from quarry.llm import packing, phrases, resampling, suffixes
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(i, "some words " * 50, "en") for i in range(9)], "doc_id long, text string, lang string").repartition(3)
rows = packing.pack(docs, tokenizer=packing.tokenizer_path()).collect()
n = suffixes.suffix_dedup(docs).where("n_removed > 0").count(), resampling.importance_resample(docs, docs).count(), phrases.collocations(docs).count()
print("packed", sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0), *n)
"""
    (tmp_path / "run.py").write_text(code)
    out = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "packed True 9 9" in out.stdout, out.stderr[-2000:]
