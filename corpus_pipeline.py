"""A corpus pipeline of operators of quarry.llm: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import BLANKS, delete, dropped, free_names, names, row_key, scratch, stored
from quarry.llm.lines import line_dedup
from quarry.llm.mixing import mixed_documents
from quarry.llm.neardup import near_duplicates
from quarry.llm.packing import pack, tokenizer_path
from quarry.llm.quality import quality_rules


def beside_text(docs: DataFrame, *columns: str) -> DataFrame:
    """The text, the named columns, and all columns but the text in a struct, where no column of an operator can clash with them."""
    return docs.select(*columns, "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_other"))


def with_text(out: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns of documents again, with text from another column and n_chars to match."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"_other.`{c}`") for c in columns])


#: Tables that the last stage's result reads. Its result is written and read again before the next stage begins.
_left: set[str] = set()


def stage(f):
    """A stage whose scratch tables go when it returns, but for those that its result reads: they go when the next stage begins
    on rows that no longer read them."""

    @wraps(f)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = names(docs)  # a chain that was not written still needs them
        if f is not STAGES[0][1].__wrapped__:
            delete(spark, _left - read)
        _left.intersection_update(read)
        with scratch(spark, _left) as keep:
            out = f(spark, docs, sf_dir)
            keep(out)
        return out

    return staged


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject; the others lose their failing lines.

    Null and empty texts have no words and go. Repeated rows are judged alike; no rows give none; other columns pass through.
    """
    out = quality_rules(beside_text(docs)).where("kept")
    return with_text(out, "cleaned", docs.columns)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that stand in ten documents or more; a document left without a word goes.

    Rows without id are one document in the count. Null texts go; repeated rows lose the same lines; no rows give none.
    """
    out = line_dedup(beside_text(docs, "doc_id")).where(F.trim("kept_text", F.lit(BLANKS)) != "")
    return with_text(out, "kept_text", docs.columns)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the least id (null last), of each group of near duplicates.

    A document is a row by id and text: of rows equal in both one stays, and rows without id or with a repeated id
    and other texts are documents of their own. Documents without words are linked with nothing. No rows give none.
    """
    (row,) = free_names(docs, "_row")
    rows = docs.withColumn(row, F.xxhash64(*row_key("doc_id", "text")))
    groups = near_duplicates(rows, doc_id=row, percent=80).select(F.col(row).alias("_row"), "component_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m")
    ids = rows.select(F.col(row).alias("_row"), "doc_id").distinct()
    keep = ids.join(groups, "_row").groupBy("component_id").agg(least).select(F.col("m._row").alias(row))
    return rows.join(keep, row, "left_semi").dropDuplicates([row]).select(docs.columns)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents to the sources' target weights.

    Null sources are one source. Texts without words have no size and go. No rows give none.
    """
    return mixed_documents(docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs into sequences of 1024 tokens; ids are in the rows. Null and empty texts are the separator alone; no rows give none."""
    return pack(docs, tokenizer=tokenizer_path(), most_words=200_000)  # ids travel too: leave them the memory


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near), ("mixing", mixing), ("packing", packing)]

#: Near duplicates are not expressible in SQL that ends on whole tables, and mixing shuffles by a Spark hash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from documents on, each stored and read again by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, one in STAGES[:-1]:
        docs = stored(one(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
