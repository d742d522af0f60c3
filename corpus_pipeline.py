"""From raw documents to packed sequences: the stages in order, each written as Parquet and read again by the next.

Each stage but the last returns the columns it was given, in their order, whatever they are called; it reads ``doc_id`` and
``text`` only (and keeps ``n_chars`` true where there is one).  Null and empty texts, repeated rows and empty tables are
rows like others, as each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.names import unused
from codeloom.llm.common import fresh_path, stored, table, tokenizer_path
from codeloom.llm.jaccard import entity_classes, with_entity
from codeloom.llm.packing import pack_documents
from codeloom.llm.pii import redact
from codeloom.llm.quality import keep_good

#: Near duplicates share at least this part of their five-word shingles.
WORDS, NUM, DEN = 5, 80, 100


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Every row is scored from its own text (null: empty), so equal texts share their fate and a null or repeated id
    changes nothing; without usable labels of both classes all rows score the share of class 1; no rows give none.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row: that of the smallest id (null ids last), of the smallest text among equal ids.

    Of several such rows the one that is least by its other columns stays.  Rows without words (null and empty texts too)
    are near no other: each id keeps one for each text, and those of null ids all stay.  No rows give none.
    """
    e, e2, id2, root, text = unused([*docs.columns, "doc_id", "text"], "_e", "_e2", "_id2", "_root", "_text")
    names, known = entity_classes(docs, words=WORDS, num=NUM, den=DEN, count_links=False)
    rows = names.join(known.select("e", "root", "component"), "e")
    # the component is the smallest id of the class, null if it has none
    last = rows.where(~F.col("doc_id").eqNullSafe(F.col("component"))).select(F.col("e").alias(e2), F.col("doc_id").alias(id2)).distinct()
    named = with_entity(docs, e)
    kept = named.join(last, (F.col(e) == F.col(e2)) & F.col("doc_id").eqNullSafe(F.col(id2)), "left_anti")
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("component")))
    many = stored(first.join(first.groupBy("root").count().where("count > 1"), "root").select(F.col("e").alias(e), F.col("root").alias(root)).distinct(), "repeated")
    bare = not names.where("e is null and doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if many.isEmpty() and not bare:
        return kept.select(docs.columns)
    # an aggregate, as copies without bound may share a class; columns that have no order do not decide
    ordered = ["text", *[c for c, kind in docs.dtypes if c != "text" and not any(x in kind for x in ("map<", "variant", "interval"))]]
    row = F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("row")
    once = kept.join(many, e).groupBy(root).agg(row).select("row.*")
    rest = kept.join(many, e, "left_anti")
    blank = F.col(e).isNull() & F.col("doc_id").isNotNull()
    bare_rows = rest.where(blank).groupBy("doc_id", F.col("text").alias(text)).agg(row).select("row.*")
    return rest.where(~blank).select(docs.columns).unionByName(once).unionByName(bare_rows)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows where there is one.

    Row by row: null texts stay null, empty and repeated rows stay as they are, no rows give none.
    """
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, of every row (a null or empty text is its end id alone); other columns end here."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality classifier", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("PII", personal_data_stage), ("packing", pack_stage)]

#: Not expressible in SQL (a trained classifier, a trained field, a tokenizer); tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{name.replace(' ', '-')}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
