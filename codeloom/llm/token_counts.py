"""Operator 3: token counts as rollups maintained by deltas.

Totals of documents, tokens and characters by source, language and tokenizer version are additive, so a change is a
signed row: +1 for an insert, -1 for a delete, and both (old and new) for a revision.  A batch of changes is aggregated
before it is shuffled and committed as one folder under its batch id; renaming the written folder into place is the
commit, so a batch that is committed again, or whose writer died half way, changes nothing.  Totals are the sums over
all committed batches.  ``compact`` folds the batches of one listing into a summary named after them; batches stay, and a
summary counts only if it shares no batch with a larger one, so compactions and commits may run at the same time.

Defined results: null source, language or text count as groups of their own, a null text has no tokens; a group whose
sums are all zero is not reported; an empty batch commits and changes nothing; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import by_batch, fresh_path, stored, table
from codeloom.llm.wordbpe import LibraryWords, shared

KEYS = ("source", "lang", "tokenizer")
SUMS = ("documents", "tokens", "chars")
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long, chars long"

#: A version's tokens are the matches of its pattern.
TOKENIZERS = {"words-v1": r"[^\x20\x09-\x0D]+", "pieces-v2": r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]"}


def token_count(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def counted(docs: DataFrame, tokenizers: tuple[str, ...], *, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, chars: a row for each document and version, without its text.

    This is what deltas are made of, so a join by id moves counts and never texts.
    """
    text = F.col("text") if text is None else text
    rows = docs.select(F.col(id_col).alias("doc_id"), "source", "lang", text.alias("text"))
    each = F.array(*[F.struct(F.lit(t).alias("tokenizer"), token_count(F.col("text"), t).alias("tokens")) for t in tokenizers])
    return rows.select("doc_id", "source", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), F.explode(each).alias("v")).select("doc_id", "source", "lang", "v.*", "chars")


def counted_ids(docs: DataFrame, version: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``counted``, for a vocabulary file: tokens are the ids of ``Tokenizer.encode(text, add_special_tokens=False)``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), "source", "lang", F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars"), F.col(text_col).cast("string").alias("_text"))
    schema = rows.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.lit(0).cast("long").alias("tokens"), "chars").schema
    names = schema.names

    def work(batch):
        for a, b, _, ends in shared(LibraryWords, tokenizer).by_slice(batch.column(4)):
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([version] * (b - a), pa.string()), pa.array(np.diff(ends)), part.column(3)], names=names)

    return by_batch(rows, work, schema)


#: Ids of revised documents that are sent to all executors at most: 8 bytes each.
MOST_SENT = 4_000_000


def recounted(docs: DataFrame, ids: DataFrame, tokenizers: tuple[str, ...], *, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """``counted`` of the documents that ``ids`` (doc_id, distinct) names, of new texts if given.

    Few ids go to the texts; with more than ``MOST_SENT``, all texts are counted and only counts travel to the ids.
    """
    if ids.count() <= MOST_SENT:
        few = ids.select(F.col("doc_id").alias(id_col))
        return counted(docs.join(F.broadcast(few), id_col, "left_semi"), tokenizers, id_col=id_col, text=text)
    return counted(docs, tokenizers, id_col=id_col, text=text).join(ids, "doc_id", "left_semi")


def inserts(counts: DataFrame) -> DataFrame:
    """A signed row for each counted document."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("documents"), "tokens", "chars")


def deletes(counts: DataFrame) -> DataFrame:
    return inserts(counts).select(*KEYS, *[(-F.col(c)).alias(c) for c in SUMS])


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts out, new counts in; a revision need not keep its group."""
    return deletes(old).unionByName(inserts(new))


def rolled_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Rollup:
    """The committed batches in one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop(self.path))

    def _at(self, name: str):
        return self._hadoop(f"{self.path}/{name}")

    def committed(self) -> list[str]:
        """Names of the folders whose sums are the totals: summaries that share no batch, and all other batches."""
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(self._hadoop(self.path)))
        folded: set[str] = set()
        out = []
        for members, name in sorted(((self._members(n), n) for n in names if n.startswith("summary=")), key=lambda x: (-len(x[0]), x[1])):
            if members and not folded & members:
                folded |= members
                out.append(name)
        return out + [n for n in names if n.startswith("batch=") and n not in folded]

    def _members(self, name: str) -> set[str]:
        """The batches that a folder stands for."""
        return {name} if name.startswith("batch=") else {r[0] for r in self.spark.read.text(f"{self.path}/{name}/members").collect()}

    def holds(self, batch_id: str) -> bool:
        return self._fs.exists(self._at(f"batch={batch_id}"))

    def _put(self, name: str, rows: DataFrame, members: list[str] | None = None) -> bool:
        staged = fresh_name(name)
        # few groups come out of a rollup: as many files as groups of partitions hold them
        rolled_up(rows).write.parquet(f"{self.path}/{staged}/rows")
        if members is not None:
            self.spark.createDataFrame([(m,) for m in members], "value string").coalesce(1).write.text(f"{self.path}/{staged}/members")
        if not self._fs.exists(self._at(name)) and self._fs.rename(self._at(staged), self._at(name)):
            # some file systems move a folder into one that is there already
            inside = self._at(f"{name}/{staged}")
            if not self._fs.exists(inside):
                return True
            self._fs.delete(inside, True)
        self._fs.delete(self._at(staged), True)
        return False

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Whether the batch was new; its rows count once however often it is sent."""
        if self.holds(batch_id):
            return False
        return self._put(f"batch={batch_id}", rows)

    def _rows(self, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/{n}/rows" for n in names]
        return self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)

    def totals(self) -> DataFrame:
        return rolled_up(self._rows(self.committed())).where("documents <> 0 or tokens <> 0 or chars <> 0")

    def compact(self) -> bool:
        """Sums what one listing names into one summary; batch folders stay as the memory of what was committed."""
        folders = self.committed()
        members = sorted(set().union(*(self._members(n) for n in folders)))
        name = hashlib.sha256("\n".join(members).encode()).hexdigest()[:32]
        return len(folders) > 1 and self._put(f"summary={name}", self._rows(folders), members)


def fresh_name(name: str) -> str:
    import uuid

    return f"_{name}-{uuid.uuid4().hex}"


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under both versions; toxic documents are taken down, and those of low quality revised by cutting symbols.

    One batch is sent twice.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    counts = stored(counted(docs, tuple(TOKENIZERS)), "counts")
    rollup.commit("load", inserts(counts))
    flags = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    toxic, low = flags.where("toxic = 1").select("doc_id"), flags.where("toxic = 0 and quality = 0").select("doc_id")
    rollup.commit("takedown", deletes(counts.join(toxic, "doc_id", "left_semi")))
    low = stored(low, "revised")
    mended = recounted(docs, low, tuple(TOKENIZERS), text=F.regexp_replace("text", "[!#$%&*|]", ""))
    rollup.commit("revise", revisions(counts.join(low, "doc_id", "left_semi"), mended))
    rollup.commit("load", inserts(counts))
    return rollup.totals()


_FINAL = """
WITH flag AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
now AS (
  SELECT d.source, d.lang, CASE WHEN f.toxic = 0 AND f.quality = 0 THEN regexp_replace(d.text, '[!#$%&*|]', '', 'g') ELSE d.text END AS text
  FROM documents d LEFT JOIN flag f USING (doc_id) WHERE coalesce(f.toxic, 0) = 0
)
"""
_EACH = r"""SELECT source, lang, '{name}' AS tokenizer, count(*)::BIGINT AS documents, coalesce(sum(len(regexp_extract_all(coalesce(text, ''), '{pattern}'))), 0)::BIGINT AS tokens, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM now GROUP BY source, lang"""

QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE_SQL = {"op3_token_counts": _FINAL + " UNION ALL ".join(_EACH.format(name=n, pattern=p) for n, p in TOKENIZERS.items())}
