"""Story packs: a ZIP file for each story, by a data source that commits whole jobs.

Tasks write their packs into folders of their own attempt.  Only when all tasks are done does the
driver move the folders of the attempts that count to their places, one move a task, and
write down what the job holds; attempts that failed or were run twice, and jobs that
broke off, leave nothing in sight.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import blank, casefold

#: The files of a pack, by column.
FILES = {"website": "website-article.txt", "facebook": "facebook-post.txt", "newsletter": "newsletter-copy.txt", "image_details": "image-details.txt", "source_link": "source-link.txt", "metadata": "metadata.json"}
PACK = "name string, " + ", ".join(f"{c} string" for c in FILES)


def file_name(prefix: Column, when: Column, suffix: str) -> Column:
    """A name with a stamp of time: ``police_20260705_142233.txt``."""
    return F.concat(prefix, F.date_format(when, "'_'yyyyMMdd'_'HHmmss"), F.lit(suffix))


def image_credit(credit: Column | str, source: Column | str, default: str) -> Column:
    """The image's own credit, else the source, else the default."""
    own = lambda c: F.nullif(F.trim(blank(c)), F.lit(""))
    return F.coalesce(own(credit), own(source), F.lit(default))


def with_credit(text: Column | str, credit: Column, *, social: bool) -> Column:
    """A format's text with the credit line after it, unless the text names the credit."""
    t = F.trim(blank(text))
    line = F.concat(F.lit("📷 Image: " if social else "Image credit: "), credit)
    return F.when((t == "") | F.contains(casefold(t), casefold(credit)), t).otherwise(F.concat(t, F.lit("\n\n"), line))


def packs(stories: DataFrame, default_credit: str = "Newsroom") -> DataFrame:
    """Stories (pos, title, source, url, published, category, tags, image_url, image_caption, image_credit,
    image_alt, website, facebook, newsletter) as packs: name and the texts of their files."""
    credit = image_credit("image_credit", "source", default_credit)
    text = lambda c: blank(c)
    image = F.struct(text("image_url").alias("source_url"), text("image_caption").alias("caption"), credit.alias("credit"), text("image_alt").alias("alt_text"))
    meta = F.struct(text("title").alias("title"), text("source").alias("source"), text("url").alias("source_url"), text("published").alias("published"), text("category").alias("classification"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), image.alias("image"))
    details = F.concat_ws("\n", F.concat(F.lit("Credit: "), credit), F.concat(F.lit("Caption: "), text("image_caption")), F.concat(F.lit("Alt text: "), text("image_alt")), F.concat(F.lit("Source: "), text("image_url")))
    slug = F.regexp_replace(F.regexp_replace(F.lower(text("title")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    name = F.concat(F.substring(F.when(slug == "", "story").otherwise(slug), 1, 60), F.lit("-"), F.col("pos").cast("string"))
    return stories.select(
        name.alias("name"), with_credit("website", credit, social=False).alias("website"), with_credit("facebook", credit, social=True).alias("facebook"),
        with_credit("newsletter", credit, social=True).alias("newsletter"), details.alias("image_details"), text("url").alias("source_link"), F.to_json(meta).alias("metadata"),
    )


def zipped(row) -> bytes:
    """The bytes of a pack; equal rows give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression=zipfile.ZIP_DEFLATED, compresslevel=6) as archive:
        for column, name in FILES.items():
            text = row[column] or ""
            if column == "metadata" and text:
                text = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def _store(path: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    uri = path.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Attempt(WriterCommitMessage):
    """What a task's attempt wrote."""

    folder: str
    packs: int


class PackWriter(DataSourceWriter):
    """Two-phase commit of packs; see the module."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _store(self):
        return _store(self.path)

    def write(self, iterator: Iterator) -> Attempt:
        store, root = self._store()
        folder, n = f"_staging-{self.job}/{uuid.uuid4().hex}", 0
        for row in iterator:
            if not n:
                store.create_dir(f"{root}/{folder}", recursive=True)
            with store.open_output_stream(f"{root}/{folder}/{row['name']}.zip") as f:
                f.write(zipped(row))
            n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        store, root = self._store()
        before = [f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith(("job-", "_job-"))] if self.overwrite else []
        place = f"job-{self.job}"
        store.create_dir(f"{root}/_{place}", recursive=True)
        counts = []
        for i, m in enumerate(messages):
            if m is not None and m.packs:
                store.move(f"{root}/{m.folder}", f"{root}/_{place}/part-{i:05d}")
                counts.append(m.packs)
        with store.open_output_stream(f"{root}/_{place}/_SUCCESS") as f:
            f.write(json.dumps({"packs": sum(counts), "parts": len(counts)}).encode())
        store.move(f"{root}/_{place}", f"{root}/{place}")  # from here on the job is there, whole
        self._clear(store, root)
        for old in before:
            store.delete_dir(old)

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        for name in (f"_staging-{self.job}", f"_job-{self.job}"):
            if store.get_file_info(f"{root}/{name}").type == fs.FileType.Directory:
                store.delete_dir(f"{root}/{name}")


class StoryPacks(DataSource):
    """``df.write.format("story_packs").mode("append").save(folder)`` for rows of :data:`PACK`."""

    @classmethod
    def name(cls) -> str:
        return "story_packs"

    def schema(self) -> str:
        return PACK

    def writer(self, schema, overwrite: bool) -> PackWriter:
        return PackWriter(self.options["path"], overwrite)


def read_packs(spark, folder: str) -> DataFrame:
    """The packs of all committed jobs in a folder: name, file and text of each of their files.

    The driver lists the folders of tasks alone; each of these is listed and read by a task of its own, so
    that no process holds the names of all packs."""
    from pyarrow import fs

    path = folder.rstrip("/")
    store, root = _store(path)
    below = lambda at, prefix: [f.base_name for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith(prefix)]
    parts = [(f"{job}/{part}",) for job in below(root, "job-") for part in below(f"{root}/{job}", "part-")]

    def opened(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = _store(path)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["name", "file", "text"])

        for part in (p for b in batches for p in b.column(0).to_pylist()):
            rows, size = [], 0
            for found in store.get_file_info(fs.FileSelector(f"{root}/{part}")):
                if not found.base_name.endswith(".zip"):
                    continue
                with store.open_input_stream(found.path) as f:
                    content = f.read()
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    rows += [(found.base_name.removesuffix(".zip"), n, archive.read(n).decode()) for n in archive.namelist()]
                size += len(content)
                if len(rows) >= 1500 or size >= 1 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    listed = spark.createDataFrame(parts, "part string").repartition(max(1, len(parts)), "part")
    return listed.mapInArrow(opened, "name string, file string, text string")
