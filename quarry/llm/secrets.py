"""Operator 8, secret scans: patterns plus multipart credential linking, in DataFrame functions only.

Positions come from splitting a text at its matches: gaps and matches alternate, so starts are a running
sum over (document, kind). Weak candidates (bare 40-character secrets, endpoints) are joined by interval to
the other parts of a credential with a range window around each; they are reported only where the
complementary parts lie within the same scope. Only documents with a match are shuffled, and only their
positions, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key

# Patterns by kind, in the order that breaks ties of start.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
SECRET = r"(?<![A-Za-z0-9/+=_.-])(?=[A-Za-z0-9/+]{0,39}[0-9])(?=[A-Za-z0-9/+]{0,39}[A-Z])(?=[A-Za-z0-9/+]{0,39}[a-z])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_.-])"
ENDPOINT = r"""\b(?:https?|wss?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}"""
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "secret": SECRET, "endpoint": ENDPOINT}


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1), x["start"], x["end"])), ",")


def secret_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", scope: int = 400, min_value: int = 12) -> DataFrame:
    """Spans per distinct (id, text) with a match: _key, _hash, base and all: arrays of (start, rank, end), code points.

    rank indexes KINDS. The base kinds are reported wherever they match: the HEX and ACCESS patterns carry
    their least length, which finds the same maximal runs; short values of assign are dropped after matching,
    since they use up text. Within scope means that so many code points or fewer lie between two spans. A bare secret is weak: reported if an access identifier, or an endpoint, lies
    within scope code points. An endpoint is weak: reported if an assigned secret, or an access identifier and
    a bare secret, do. Weak spans inside assigned ones are left out. Null text has no spans.
    """
    found = lambda p: F.when(F.col(text).rlike(p), F.zip_with(F.regexp_extract_all(text, F.lit(p), 0), F.split(text, p, -1), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("length"), m.isNotNull().alias("match"))))
    value = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), 2), F.length)
    hits = docs.select(*row_key(doc_id, text), *[found(p).alias(k) for k, p in KINDS.items()], F.when(F.col(text).rlike(ASSIGN), value).alias("value"))
    hits = hits.where(F.greatest(*[F.col(k).isNotNull() for k in KINDS]))
    hits = hits.groupBy("_key", "_hash").agg(*[F.first(k).alias(k) for k in [*KINDS, "value"]])  # repeated rows count once
    none = F.lit(None).cast("array<int>")
    kind = F.array(*[F.struct(F.lit(rank).alias("rank"), F.col(k).alias("m"), (F.col("value") if k == "assign" else none).alias("value")) for rank, k in enumerate(KINDS)])
    rows = hits.select("_key", "_hash", F.explode(kind).alias("kind"))  # all kinds in one pass over the texts
    rows = rows.select("_key", "_hash", F.col("kind.rank").alias("rank"), F.col("kind.value").alias("_values"), F.posexplode("kind.m").alias("n", "m"))
    rows = rows.select("_key", "_hash", "rank", "n", "m", F.when(F.col("rank") == 0, F.get("_values", F.col("n"))).otherwise(F.lit(min_value)).alias("value"))
    before = Window.partitionBy("_key", "_hash", "rank").orderBy("n")
    rows = rows.where("m.match").select("*", (F.sum(F.col("m.gap") + F.col("m.length")).over(before)).alias("end")).where(F.col("value") >= min_value)
    rows = rows.select("_key", "_hash", "rank", (F.col("end") - F.col("m.length")).alias("start"), "end")
    earlier = Window.partitionBy("_key", "_hash").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("_key", "_hash").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    of = lambda k, c: F.when(F.col("rank") == list(KINDS).index(k), F.col(c))
    has = lambda k: F.coalesce(F.max(of(k, "end")).over(earlier) >= F.col("start") - scope, F.lit(False)) | F.coalesce(F.min(of(k, "start")).over(later) <= F.col("end") + scope, F.lit(False))
    rows = rows.select("*", *[has(k).alias(f"has_{k}") for k in ("assign", "access", "secret", "endpoint")], F.max(F.when(F.col("rank") == 0, F.col("end"))).over(earlier).alias("assigned"))
    free = F.coalesce(F.col("assigned") <= F.col("start"), F.lit(True))
    weak = F.when(F.col("rank") == 3, free & (F.col("has_access") | F.col("has_endpoint"))).when(F.col("rank") == 4, free & (F.col("has_assign") | (F.col("has_access") & F.col("has_secret"))))
    rows = rows.where((F.col("rank") < 3) | weak)
    span = F.struct("start", "rank", "end")
    return rows.groupBy("_key", "_hash").agg(F.collect_list(F.when(F.col("rank") < 3, span)).alias("base"), F.collect_list(span).alias("all"))


def secret_scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: the id, n_assign, n_access, n_hex (long), base_spans, spans (strings kind:start:end by start).

    Null or empty text gives zeros and empty strings; repeated rows give repeated results. Texts are scanned whole, however
    long; an empty table gives none. Other columns of the input, whatever their names, play no part.
    """
    docs = docs.select(doc_id, text)
    found = secret_spans(docs, doc_id=doc_id, text=text, **options)
    out = docs.select(F.col(doc_id), *row_key(doc_id, text)).join(found, ["_key", "_hash"], "left")
    count = lambda r: F.coalesce(F.size(F.filter("base", lambda x: x["rank"] == r)), F.lit(0)).cast("long")
    count_or_0 = lambda r: F.when(F.col("base").isNull(), F.lit(0).cast("long")).otherwise(count(r))
    return out.select(doc_id, *[count_or_0(r).alias(f"n_{k}") for r, k in enumerate(["assign", "access", "hex"])], F.coalesce(joined(F.col("base")), F.lit("")).alias("base_spans"), F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return secret_scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
