"""Spreadsheet scan: the interface; reading needs openpyxl, which is optional."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def cell_text(v) -> str:
    """A cell as text: midnight date-times as dates, whole floats as integers, nothing as an empty text."""
    if v is None:
        return ""
    if isinstance(v, datetime) and (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0):
        return v.date().isoformat()
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v).strip()


class SheetReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, columns: list[str]):
        self.path, self.sheet, self.columns = path, sheet, columns

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import openpyxl

        book = openpyxl.load_workbook(self.path, read_only=True, data_only=True)
        rows = ([cell_text(v) for v in r] for r in (book[self.sheet] if self.sheet else book.active).iter_rows(values_only=True))
        head = next((r for r in rows if any(r)), [])
        at = [head.index(c) for c in self.columns]
        yield from (tuple(r[i] if i < len(r) else "" for i in at) for r in rows if any(r))


class SheetSource(DataSource):
    """``spark.read.format("sheet").schema(..).option("sheet", name).load(path)``: the first row with a value is the header."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self):
        raise ValueError("a sheet needs a schema of its text columns")

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options["path"], self.options.get("sheet"), schema.names)
