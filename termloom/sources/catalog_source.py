"""A Spark data source that presents catalogs kept elsewhere as concept tables: spark.read.format("concepts_json").load(path)."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "iri string, label string, definition string, alternative_labels array<string>, preferred_label string, branch string, parent_iris array<string>"


class ConceptsJson(DataSource):
    """Files of JSON lines, one concept each, one partition per file. Texts that aren't strings count as absent; a missing label is the preferred one; an option
    ``root`` keeps only IRIs of that namespace."""

    @classmethod
    def name(cls) -> str:
        return "concepts_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.root = options["path"], options.get("root", "")

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "*.json*"))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        text = lambda v: v if isinstance(v, str) and v else None
        many = lambda v: [x for x in v if isinstance(x, str)] if isinstance(v, list) else []
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                if not line.strip():
                    continue
                c = json.loads(line)
                iri = text(c.get("iri"))
                if iri is None or not iri.startswith(self.root):
                    continue
                preferred = text(c.get("preferred_label"))
                yield (iri, text(c.get("label")) or preferred or "", text(c.get("definition")), many(c.get("alternative_labels")), preferred, text(c.get("branch")) or "", many(c.get("parent_iris") or c.get("sub_class_of")))
