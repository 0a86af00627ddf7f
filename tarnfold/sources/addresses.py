"""Addresses of the portal's pages, for strings and for columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Addresses:
    base: str
    org: str

    def organization(self) -> str:
        return f"{self.base}/Public/Organization/{self.org}"

    def agenda(self, meeting_id: str) -> str:
        return f"{self.base}/Public/Agenda/{self.org}?meeting={meeting_id}"

    def minutes(self, meeting_id: str) -> str:
        return f"{self.base}/Public/Minutes/{self.org}?meeting={meeting_id}"

    def packet(self, meeting_id: str) -> str:
        return f"{self.base}/Public/DownloadAgenda/{self.org}?meeting={meeting_id}"

    def viewer(self, file_id: str) -> str:
        return f"{self.base}/Documents/FileViewerOrPublic/{self.org}?file={file_id}"

    def pdf(self, file_id: str) -> str:
        return f"{self.base}/Documents/DownloadPDF/{file_id}?org={self.org}"

    def column(self, kind: str, key: Column) -> Column:
        """The address of `kind` for each key."""
        before, after = getattr(self, kind)("\0").split("\0")
        return F.concat(F.lit(before), key.cast("string"), F.lit(after))
