"""Sinks with commit and abort: a nested dataset in sections, and request lines, by Spark's Python data sources.

    dataset.json                  meta (counts and given values) and the part files of each section
    parts-<id>/debates-0-17.json  JSON objects, one a line, as one task wrote them

Tasks write parts; nobody sees them until the commit renames `dataset.json` into place, which is also
where the path is guarded. An abort, and the next commit, delete what no manifest names. The driver
handles names and counts only, never the rows.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "evidence_document"
MANIFEST = "dataset.json"


def guard_path(path: str, public: str | None, internal: bool) -> None:
    """Raise where an internal artefact would stand under the public path."""
    if internal and public and (posixpath.normpath(path) + "/").startswith(posixpath.normpath(public) + "/"):
        raise PermissionError(f"{path} is under the public {public}")


def may_stand(path: Column, public: str, internal: Column) -> Column:
    """The rule of `guard_path` for a column of paths: false for an internal artefact under the public path; null for a null path."""
    plain = F.regexp_replace(F.regexp_replace(F.concat(path, F.lit("/")), r"/(\./)+", "/"), "(?<!:)/{2,}", "/")
    return ~(internal & plain.startswith(posixpath.normpath(public) + "/"))


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: the files of each section and the sums of its counts."""

    files: list[tuple[str, str]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)


class DocumentSource(DataSource):
    """Rows of section, body (a JSON object) and counts (a map that is summed into meta)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "section string, body string, counts map<string, bigint>"

    def writer(self, schema: T.StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), overwrite)


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.public, self.internal = options.get("public"), options.get("internal", "false").lower() == "true"
        self.meta = json.loads(options.get("meta", "{}"))
        self.parts = f"parts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _filesystem(self.path)
        fs.create_dir(f"{root}/{self.parts}", recursive=True)
        streams, files, counts = {}, [], Counter()
        try:
            for row in rows:
                section = row["section"]
                if section not in streams:
                    name = f"{self.parts}/{section}-{task.partitionId()}-{task.taskAttemptId()}.json"
                    streams[section] = fs.open_output_stream(f"{root}/{name}")
                    files.append((section, name))
                streams[section].write(row["body"].encode() + b"\n")
                counts.update(row["counts"] or {})
        finally:
            for stream in streams.values():
                stream.close()
        return Written(files, dict(counts))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.path)
        try:
            guard_path(self.path, self.public, self.internal)
        except PermissionError:
            self.abort(messages)
            raise
        done = [m for m in messages if m is not None]
        counts, sections = Counter(), {}
        if not self.overwrite:
            before = self._before(fs, root)
            counts.update({k: v for k, v in before.get("meta", {}).items() if isinstance(v, int)})
            sections = before.get("sections", {})
        for m in done:
            counts.update(m.counts)
            for section, name in sorted(m.files):
                sections.setdefault(section, []).append(name)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/.{self.parts}") as out:
            out.write(json.dumps({"meta": self.meta | dict(counts), "sections": sections}, ensure_ascii=False, separators=(",", ":")).encode())
        fs.move(f"{root}/.{self.parts}", f"{root}/{MANIFEST}")
        self._clean(fs, root, {name for names in sections.values() for name in names})

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs as afs

        fs, root = _filesystem(self.path)
        if fs.get_file_info(f"{root}/{self.parts}").type == afs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.parts}")

    @staticmethod
    def _before(fs, root: str) -> dict:
        from pyarrow import fs as afs

        if fs.get_file_info(f"{root}/{MANIFEST}").type != afs.FileType.File:
            return {}
        with fs.open_input_stream(f"{root}/{MANIFEST}") as stream:
            return json.loads(stream.readall())

    @staticmethod
    def _clean(fs, root: str, named: set[str]) -> None:
        """Delete parts that the manifest does not name: those of failed attempts and of what was overwritten."""
        from pyarrow import fs as afs

        for folder in fs.get_file_info(afs.FileSelector(root)):
            if folder.type == afs.FileType.Directory and folder.base_name.startswith("parts-"):
                for part in fs.get_file_info(afs.FileSelector(folder.path)):
                    if f"{folder.base_name}/{part.base_name}" not in named:
                        fs.delete_file(part.path)
                if not any(n.startswith(f"{folder.base_name}/") for n in named):
                    fs.delete_dir(folder.path)


def section(rows: DataFrame, name: str, counter: str, columns: list[str] | None = None, drop: tuple[str, ...] = (), **counts: Column) -> DataFrame:
    """Rows as a section of a document: null fields are left out, `counter` counts the rows and each of `counts` is summed."""
    columns = [c for c in columns or rows.columns if c not in drop]
    pairs = [x for k, v in counts.items() for x in (F.lit(k), F.coalesce(v.cast("bigint"), F.lit(0)))]
    return rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*columns)).alias("body"), F.create_map(F.lit(counter), F.lit(1).cast("bigint"), *pairs).alias("counts"))


def dataset(debates: DataFrame, people: DataFrame, parties: DataFrame, drop: tuple[str, ...] = ("rawText",)) -> DataFrame:
    """Sections of the nested dataset. debates has `messages`, an array of structs in order, whose fields named in drop go.

    meta counts debates, messages, analysed messages (with the field analyzedAt), annotations (with the
    field annotations), people and parties.
    """
    fields = [f.name for f in debates.schema["messages"].dataType.elementType.fields]
    messages = F.coalesce("messages", F.array().cast(debates.schema["messages"].dataType))
    counts = {"messageCount": F.size(messages)}
    if "analyzedAt" in fields:
        counts["analyzedMessageCount"] = F.size(F.filter(messages, lambda m: m["analyzedAt"].isNotNull()))
    if "annotations" in fields:
        counts["annotationCount"] = F.aggregate(messages, F.lit(0), lambda a, m: a + F.greatest(F.size(m["annotations"]), F.lit(0)))
    whole = debates.select("*", *[v.alias(f"_{k}") for k, v in counts.items()])
    slim = whole.withColumn("messages", F.transform(messages, lambda m: F.struct(*[m[f].alias(f) for f in fields if f not in drop])))
    sections = [section(slim, "debates", "debateCount", debates.columns, drop, **{k: F.col(f"_{k}") for k in counts})]
    sections += [section(people, "people", "personCount"), section(parties, "parties", "partyCount")]
    return sections[0].unionByName(sections[1]).unionByName(sections[2])


def write_document(rows: DataFrame, path: str, public: str | None = None, internal: bool = False, meta: dict | None = None, append: bool = False) -> None:
    """Write sections at path in one commit; without append they replace what is there.

    An internal artefact never stands under the public path: nothing of it stays there.
    """
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSource)
    out = rows.write.format(FORMAT).option("path", path).option("meta", json.dumps(meta or {})).option("internal", str(internal).lower())
    (out.option("public", public) if public else out).mode("append" if append else "overwrite").save()


def manifest(spark: SparkSession, path: str) -> dict:
    """meta and sections of a document."""
    return json.loads(spark.read.option("wholetext", True).text(f"{path.rstrip('/')}/{MANIFEST}").first()[0])


def read_section(spark: SparkSession, path: str, name: str, schema: T.StructType | str) -> DataFrame:
    """The rows of one section of a document; none if it has no such section."""
    files = manifest(spark, path)["sections"].get(name, [])
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/{f}" for f in files]) if files else spark.createDataFrame([], schema)


REQUEST = "cache_key string, role string, model string, system string, user string"


def write_requests(requests: DataFrame, path: str, append: bool = True) -> None:
    """Pending model requests, a JSON object a line; a second call adds to them."""
    write_document(section(requests, "requests", "requestCount", ["cache_key", "role", "model", "system", "user"]), path, append=append)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests by cache key, each once."""
    return read_section(spark, path, "requests", REQUEST).dropDuplicates(["cache_key"])
