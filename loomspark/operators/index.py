"""The index driver: a stored index of source files, built once and refreshed by what changed.

A generation holds the files (file_id, path, sha, lang, status, note) and their symbols. A refresh compares the hashes of the
files that are there now with those of the newest generation, parses only files that are new or changed, and carries the
symbols of the others over. A generation counts once its marker is there, so a refresh that dies leaves the one before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code

# Folders that hold no sources of one's own.
IGNORED = [".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", ".tox", ".mypy_cache", ".pytest_cache"]
FILES = "file_id string, path string, sha string, lang string, status string, note string"


def scan_tree(spark: SparkSession, root: str, ignored: list[str] = IGNORED) -> DataFrame:
    """(path, text) of all files below a folder, read by the executors; path is relative to it. Folders in `ignored` are left out. Bytes that are no UTF-8 give a null text."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    name = base.split("://")[-1].split("/")[-1]
    rel = F.regexp_extract("path", rf".*?/\Q{name}\E/(.*)$", 1)
    kept = raw.select(rel.alias("path"), "content").filter(~F.exists(F.slice(F.split("path", "/"), 1, F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1)), lambda x: x.isin(ignored)))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return kept.select("path", text.alias("text"))


class CodeIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _newest(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max((int(n[1:]) for n in names if n[0] == "g" and n[1:].isdigit()), default=0)

    def _at(self, what: str) -> DataFrame:
        n = self._newest()
        schema = FILES if what == "files" else code._SYMBOL
        if not n:
            return self.spark.createDataFrame([], schema)
        into = self._fs.open(self._path(f"{self.root}/g{n}"))
        folder = bytes(into.readAllBytes()).decode()
        into.close()
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/{what}")

    def files(self) -> DataFrame:
        return self._at("files")

    def symbols(self) -> DataFrame:
        return self._at("symbols")

    def calls(self) -> tuple[DataFrame, DataFrame]:
        """(edges, unresolved) of all symbols; they depend on all files together, so they are resolved anew from the stored symbols."""
        return code.resolve_calls(self.symbols(), self.spark.createDataFrame([], "from_id string, to_id string, deferred boolean"))

    def compare(self, files: DataFrame) -> DataFrame:
        """(file_id, change) of files (file_id, path, text): 'added', 'changed', 'removed' or 'same' against the newest generation."""
        return self._changes(self._listed(files))

    def _changes(self, listed: DataFrame) -> DataFrame:
        now = listed.select("file_id", "sha")
        old = self.files().select("file_id", F.col("sha").alias("old"))
        j = now.join(old, "file_id", "full_outer")
        change = F.when(F.col("old").isNull(), "added").when(F.col("sha").isNull(), "removed").when(F.col("old") != F.col("sha"), "changed").otherwise("same")
        return j.select("file_id", change.alias("change"))

    @staticmethod
    def _listed(files: DataFrame) -> DataFrame:
        """One row a file; of several texts under one id the greatest. A null text counts as unreadable."""
        f = files.filter(F.col("file_id").isNotNull()).groupBy(F.col("file_id").cast("string").alias("file_id")).agg(F.max(F.struct(F.coalesce("path", F.lit("")).alias("path"), "text")).alias("f")).select("file_id", "f.path", "f.text")
        size = F.octet_length("text")
        note = F.when(F.col("text").isNull(), "unreadable").when(size > code.MAX_BYTES, F.concat(F.lit("too large: "), size, F.lit(" bytes")))
        return f.select("file_id", "path", F.coalesce(F.sha2("text", 256), F.lit("")).alias("sha"), code.language_column(F.col("path")).alias("lang"), F.when(note.isNull(), "indexed").otherwise("skipped").alias("status"), note.alias("note"), "text")

    def refresh(self, files: DataFrame) -> DataFrame:
        """Bring the index to files (file_id, path, text); returns (change, n). The first refresh builds it. Files that can't be indexed stay listed with a note."""
        base, folder = self._newest(), f"d-{uuid.uuid4().hex}"
        listed = self._listed(files)
        listed.drop("text").write.parquet(f"{self.root}/{folder}/files")
        change = self._changes(self.spark.read.schema(FILES).parquet(f"{self.root}/{folder}/files"))  # as written, so texts are not moved again for their hashes
        todo = change.filter(F.col("change").isin("added", "changed")).select("file_id")
        fresh = code.symbols(listed.filter("status = 'indexed'").join(todo, "file_id", "left_semi").select("file_id", "text"), "file_id", "text")
        kept = self.symbols().join(change.filter("change = 'same'").select("file_id"), "file_id", "left_semi")
        kept.select(*fresh.columns).unionByName(fresh).write.parquet(f"{self.root}/{folder}/symbols")
        report = change.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
        rows = [tuple(r) for r in report.collect()]  # four kinds
        out = self._fs.create(self._path(f"{self.root}/g{base + 1}"), False)  # fails if another refresh was first
        out.write(bytearray(folder.encode()))
        out.close()
        return self.spark.createDataFrame(rows, "change string, n long")
