"""Sorted lists of texts by word, kept once in the shared folder and read where they are asked for."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import shared_folder

BUCKETS = 32  # folders that words are dealt to by hash


def post(told: DataFrame) -> str:
    """Write (word, text) rows sorted by both, in BUCKETS folders; the path. Row groups are small, so that a word's are found by their bounds."""
    path = shared_folder(told.sparkSession, "postings")
    dealt = told.select(F.pmod(F.crc32("word"), F.lit(BUCKETS)).alias("bucket"), "word", "text").repartition("bucket")
    dealt.sortWithinPartitions("bucket", "word", "text").write.option("parquet.block.size", 1 << 20).partitionBy("bucket").parquet(path)
    return path


@lru_cache(maxsize=64)
def _files(path: str, bucket: int) -> tuple:
    """(file, [(least word, greatest word) of each row group]) of a bucket."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    at, folder = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    found = at.get_file_info(fs.FileSelector(f"{folder}/bucket={bucket}", allow_not_found=True))
    out = []
    for info in found:
        if info.path.endswith(".parquet"):
            file = pq.ParquetFile(at.open_input_file(info.path))
            stats = [file.metadata.row_group(i).column(0).statistics for i in range(file.num_row_groups)]
            out.append((file, [(s.min, s.max) if s is not None and s.has_min_max else None for s in stats]))
    return tuple(out)


def _texts(file, bounds: list, word: str) -> Iterator[str]:
    import pyarrow.compute as pc

    for i, b in enumerate(bounds):
        if b is None or b[0] <= word <= b[1]:
            for batch in file.iter_batches(4096, [i], ["word", "text"]):
                yield from batch.column("text").filter(pc.equal(batch.column("word"), word)).to_pylist()


class Posted(Sequence):
    """The distinct texts of some words, in order: the first is at hand, all others are read from the folders as they are asked for."""

    def __init__(self, paths: list[str], words: list[str], first: str | None) -> None:
        self.paths, self.words, self.first = paths, words, first

    def __iter__(self) -> Iterator[str]:
        if self.first is None:
            return
        yield self.first
        yield from islice(self._all(), 1, None)

    def _all(self) -> Iterator[str]:
        from zlib import crc32

        each = [_texts(f, bounds, w) for w in self.words for p in self.paths for f, bounds in _files(p, crc32(w.encode()) % BUCKETS)]
        return (text for text, _ in groupby(heapq.merge(*each)))

    def __bool__(self) -> bool:
        return self.first is not None

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def __getitem__(self, i):
        if isinstance(i, int) and i >= 0:
            for text in islice(self, i, None):
                return text
            raise IndexError(i)
        return list(self)[i]
