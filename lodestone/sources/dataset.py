"""Writer of detection datasets: images and label files by split, with one manifest, as a batch data source.

    rows.write.format("detection_dataset").mode("append").save(path)

rows: split STRING, name STRING, image BINARY, label STRING. Each task writes its files below a folder of the write and
tells what it wrote; the commit adds these messages up into one manifest, moves images and labels to their place and
writes the manifest last. Until then nothing is visible, and a write that fails leaves nothing behind. A task that runs
again writes the same names.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

COLUMNS = ("split", "name", "image", "label")
#: The classes of a label line's first number.
CLASSES = ("card", "card_top", "card_bottom")
MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    samples: dict[str, int]
    lines: dict[str, int]
    image_bytes: int


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


class DetectionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, extension: str):
        self.path, self.extension, self.draft = path.rstrip("/"), extension, f"_draft-{uuid.uuid4().hex}"
        store, root = store_of(self.path)
        found = store.get_file_info(root)
        if found.type == stores.FileType.File or found.type == stores.FileType.Directory and store.get_file_info(stores.FileSelector(root)):
            raise FileExistsError(f"{self.path} is not empty")
        store.create_dir(f"{root}/{self.draft}", recursive=True)

    def write(self, parts: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.path)
        made, samples, lines, size = set(), Counter(), Counter(), 0
        for part in parts:
            for split, name, image, label in zip(*(part.column(c).to_pylist() for c in COLUMNS)):
                if split is None or name is None or not (split + name).replace("_", "").replace("-", "").isalnum():
                    raise ValueError(f"split and name have to be plain words: {split!r}, {name!r}")
                for kind, ending, content in (("images", self.extension, image or b""), ("labels", "txt", (label or "").encode())):
                    folder = f"{root}/{self.draft}/{kind}/{split}"
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    with store.open_output_stream(f"{folder}/{name}.{ending}") as out:
                        out.write(content)
                samples[split] += 1
                lines[split] += sum(1 for x in (label or "").splitlines() if x.strip())
                size += len(image or b"")
        return Written(dict(samples), dict(lines), size)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        told = [m for m in messages if m is not None]
        samples, lines = (sum((Counter(getattr(m, name)) for m in told), Counter()) for name in ("samples", "lines"))
        for kind in ("images", "labels"):
            if store.get_file_info(f"{root}/{self.draft}/{kind}").type == stores.FileType.Directory:
                store.move(f"{root}/{self.draft}/{kind}", f"{root}/{kind}")
        store.delete_dir(f"{root}/{self.draft}")
        manifest = {"names": dict(enumerate(CLASSES)), "splits": {s: {"images": f"images/{s}", "labels": f"labels/{s}", "samples": samples[s], "lines": lines[s]} for s in sorted(samples)}, "image_bytes": sum(m.image_bytes for m in told)}
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(manifest, indent=1).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        store.delete_dir(f"{root}/{self.draft}")


class DetectionDataset(DataSource):
    @classmethod
    def name(cls) -> str:
        return "detection_dataset"

    def schema(self) -> str:
        return "split string, name string, image binary, label string"

    def writer(self, schema: StructType, overwrite: bool) -> DetectionWriter:
        if overwrite:
            raise ValueError("a dataset is never overwritten: choose an empty folder and mode append")
        if missing := [c for c in COLUMNS if c not in schema.names]:
            raise ValueError(f"columns are missing: {missing}")
        return DetectionWriter(self.options["path"], self.options.get("extension", "jpg"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DetectionDataset)
