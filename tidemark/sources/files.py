"""Tables as versioned folders: a new version is written whole and then published by one new pointer file."""

from __future__ import annotations

import bisect
import itertools
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.merge import upsert
from tidemark.scratch import drop, keep

#: Rows of a file of a table that is kept in key order.
FILE_ROWS = 1_000_000
#: A batch times so much as large as the table is merged into it whole.
LARGE = 4


def counting(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """``df`` that counts its rows while something else reads it, and what gives the count afterwards."""
    seen = Observation()

    def told() -> int:
        try:
            return seen.get["n"]
        except Exception:  # the planner saw that there is nothing to read, and dropped the counter
            return df.count()

    return df.observe(seen, F.count(F.lit(1)).alias("n")), told


def _ordered(key: Iterable) -> tuple:
    """A key as Python sorts it like Spark: nulls first."""
    return tuple((v is not None, v) for v in key)


class KeyIndex:
    """Key ranges of a table's files, in order of their least keys. It has a row for each file, as has the list of
    files that a version is: both are held on the driver."""

    def __init__(self, keys: list[str], rows: list[tuple[str, int, tuple, tuple]]):
        """rows: file, number of rows, least and greatest key."""
        self.keys = keys
        self.rows = sorted(rows, key=lambda r: (_ordered(r[2]), r[0]))
        self.low = [_ordered(r[2]) for r in self.rows]
        self.high = [_ordered(r[3]) for r in self.rows]
        #: Greatest key of all files up to each: no file before one where this is less can hold a key.
        self.reach = list(itertools.accumulate(self.high, max))

    def places(self, key: tuple) -> list[int]:
        """Numbers of the files whose range holds a key."""
        out, at = [], bisect.bisect_right(self.low, key) - 1
        while at >= 0 and self.reach[at] >= key:
            if self.high[at] >= key:
                out.append(at)
            at -= 1
        return out

    def touched(self, df: DataFrame) -> list[int]:
        """Files that may hold a key of ``df``: each task tells the numbers it met, once."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def met(batches):
            index, found, last = shared.value, set(), None
            for batch in batches:
                for key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key != last:
                        found.update(index.places(_ordered(key)))
                        last = key
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["file"])

        return sorted(r["file"] for r in df.select(*self.keys).mapInArrow(met, "file int").distinct().collect())


class VersionedTable:
    """``root`` holds folders of data and numbered pointers, each a list of the folders or files of a version.

    A pointer is written aside and renamed to its number, which is one step of the file system; the highest
    number counts. Until then the version before is what readers get, and whoever began to read it still can:
    it goes when the version after the next is published. A crash leaves folders that no pointer names.

    A table that was merged into is kept in key order, with an index of its files' key ranges that the pointer names too.
    A merge then rewrites only the files whose ranges hold a key of the changes; all others are named again by the next version.
    """

    file_rows = FILE_ROWS

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/_pointers")
        if not fs.exists(p):
            return []
        return sorted(int(n) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.isdigit())

    def _folders(self, number: int) -> list[str]:
        return [r["value"] for r in self.spark.read.text(f"{self.root}/_pointers/{number:012d}").collect()]

    def version(self) -> int | None:
        return max(self._pointers(), default=None)

    def exists(self) -> bool:
        return self.version() is not None

    def read(self) -> DataFrame:
        version = self.version()
        if version is None:
            raise FileNotFoundError(f"no table at {self.root}")
        return self._reader([f for f in self._folders(version) if not f.startswith("index-")])

    def _reader(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in names])

    def index(self) -> KeyIndex | None:
        """The index of the version that counts; None where it has none."""
        version = self.version()
        name = next((f for f in self._folders(version) if f.startswith("index-")), None) if version is not None else None
        if name is None:
            return None
        df = self._reader([name])
        keys = df.schema["low"].dataType.fieldNames()
        return KeyIndex(keys, [(r["file"], r["n"], tuple(r["low"]), tuple(r["high"])) for r in df.collect()])

    def holding(self, df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        """The rows of the files that may hold the keys which ``df`` has in ``columns``; all rows without an index by these keys."""
        index = self.index()
        if index is None or index.keys != keys:
            return self.read()
        files = [index.rows[i][0] for i in index.touched(df.select(*[F.col(c).alias(k) for c, k in zip(columns, keys, strict=True)]))]
        return self._reader(files) if files else self.read().limit(0)

    def publish(self, df: DataFrame) -> int:
        """Replace the table; the number of rows."""
        folder = f"data-{uuid.uuid4().hex}"
        df, rows = counting(df)
        df.write.parquet(f"{self.root}/{folder}")
        self.point([folder])
        return rows()

    def point(self, folders: list[str]) -> None:
        """Publish a version of these folders and delete what only older ones than the last name."""
        numbers = self._pointers()
        number = (numbers[-1] if numbers else 0) + 1
        fs, aside = self._fs(f"{self.root}/_aside-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray("\n".join(folders).encode()))
        out.close()
        _, place = self._fs(f"{self.root}/_pointers/{number:012d}")
        fs.mkdirs(place.getParent())
        if fs.exists(place) or not fs.rename(aside, place):
            fs.delete(aside, False)
            raise OSError(f"another writer published version {number} of {self.root}")
        named = {f for n in [*numbers[-1:], number] for f in self._folders(n)}
        for n in numbers[:-1]:
            for f in set(self._folders(n)) - named:
                # A folder of which single files go on is left to them.
                if not any(x.startswith(f"{f}/") for x in named):
                    fs.delete(self._fs(f"{self.root}/{f}")[1], True)
            fs.delete(self._fs(f"{self.root}/_pointers/{n:012d}")[1], False)

    def merge(self, changes: DataFrame, keys: list[str]) -> int:
        """Put the changes in; their number. A batch of a quarter of the table or more rewrites it as it comes, without an order."""
        target = self.read()
        if LARGE * changes.count() >= target.count():
            changes, counted = counting(changes.select(*target.columns))
            self.publish(upsert(target, changes, keys))
            return counted()
        rows, kept = self.merge_kept(changes, keys)
        drop(kept)
        return rows

    def merge_kept(self, changes: DataFrame, keys: list[str]) -> tuple[int, DataFrame]:
        """Put the changes in; their number, and the changes as a kept table.

        Of an indexed table only files whose key range holds a key of theirs are read and written, and with them small
        ones of together no more than a file's rows. The first small merge of a table rewrites it in key order and indexes it; one
        of a quarter of its rows or more writes all of it, without order or index.
        """
        target = self.read()
        changes, counted = counting(changes.select(*target.columns))
        kept = keep(changes, "changes")
        rows, index = counted(), self.index()
        if not rows:
            return 0, kept
        if LARGE * rows >= target.count():
            self.publish(upsert(target, kept, keys))
            return rows, kept
        if index is None or index.keys != keys:
            merged, n, left = upsert(target, kept, keys), None, []
        else:
            at = set(index.touched(kept))
            room = self.file_rows
            for i in sorted(set(range(len(index.rows))) - at, key=lambda i: index.rows[i][1]):
                if index.rows[i][1] > min(room, self.file_rows // 4):
                    break
                room -= index.rows[i][1]
                at.add(i)
            old = self._reader([index.rows[i][0] for i in sorted(at)]) if at else target.limit(0)
            merged, n = upsert(old, kept, keys), rows + sum(index.rows[i][1] for i in at)
            left = [r for i, r in enumerate(index.rows) if i not in at]
        self._publish_ordered(merged, keys, left, n)
        return rows, kept

    def _publish_ordered(self, df: DataFrame, keys: list[str], left: list[tuple], rows: int | None) -> None:
        """A version of ``df`` in key order, written as files of about ``file_rows`` rows, and of files that are left as they are."""
        folder, index = f"data-{uuid.uuid4().hex}", f"index-{uuid.uuid4().hex}"
        # Kept, since the bounds of ranges come from a look at the rows before they are dealt.
        whole = keep(df, "merged")
        rows = whole.count() if rows is None else rows
        whole.repartitionByRange(max(1, -(-rows // self.file_rows)), *keys).sortWithinPartitions(*keys).write.parquet(f"{self.root}/{folder}")
        drop(whole)
        key = F.struct(*keys)
        file = F.concat(F.lit(f"{folder}/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        new = self._reader([folder]).select(file.alias("file"), key.alias("key")).groupBy("file").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        if left:
            new = new.unionByName(self.spark.createDataFrame([(f, n, low, high) for f, n, low, high in left], new.schema))
        new.coalesce(1).write.parquet(f"{self.root}/{index}")
        names = [r["file"] for r in self._reader([index]).select("file").orderBy("file").collect()]
        self.point([*(names or [folder]), index])

    def append(self, df: DataFrame) -> None:
        """A version of the folders there are and one more: nothing is copied, and nobody sees half of it. An index goes."""
        version = self.version()
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        self.point([*(f for f in (self._folders(version) if version is not None else []) if not f.startswith("index-")), folder])

    def stage(self, df: DataFrame, run: str, part: int) -> tuple[str, int]:
        """Write one part of a version that is not published yet; its folder and rows. Writing it again replaces it."""
        folder = f"part-{run}-{part}"
        df, rows = counting(df)
        df.write.mode("overwrite").parquet(f"{self.root}/{folder}")
        return folder, rows()

    def discard(self, folders: list[str]) -> None:
        """Delete folders that no version names."""
        named = {f for n in self._pointers() for f in self._folders(n)}
        for f in folders:
            if f not in named:
                fs, p = self._fs(f"{self.root}/{f}")
                fs.delete(p, True)

    def drop(self) -> None:
        fs, p = self._fs(self.root)
        fs.delete(p, True)


def write_tsv(df: DataFrame, path: str) -> None:
    r"""Tab-separated text as LOAD DATA reads it: escapes as in escape_tsv, null as \N."""
    from tidemark.functions.convert import escape_tsv

    line = F.concat_ws("\t", *[escape_tsv(F.col(c).cast("string")) for c in df.columns])
    df.select(line.alias("value")).write.text(path)
