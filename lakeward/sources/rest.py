"""A paginated REST collection as a Spark data source.

Options: ``start`` holds the first addresses, comma-separated (one partition each);
``pages`` is an importable function (module:name) from an address to the parsed page,
``{"results": [...], "next": address or null}``. A page may only lead on to the host it
came from, over https.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def same_host(first: str, following: str) -> bool:
    a, b = urlsplit(first), urlsplit(following)
    return b.scheme == "https" and a.netloc == b.netloc


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(a) for a in self.options["start"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, name = self.options["pages"].split(":")
        fetch = getattr(importlib.import_module(module), name)
        first = address = partition.value
        while address:
            page = fetch(address)
            for record in page["results"]:
                yield first, json.dumps(record, sort_keys=True)
            address = page.get("next")
            if address and not same_host(first, address):
                raise ValueError(f"{first} leads on to another host")


class RestCollection(DataSource):
    """Rows (collection, record): the address and each record as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "rest_collection"

    def schema(self) -> str:
        return "collection string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
