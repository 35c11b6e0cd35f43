"""Order documents as files, one valid file an order or none (K1).

Many tasks write: fragments come in ranges of (order_id, fragment_no), and each task writes what it has of
an order as one piece, and a list of its pieces, into a staging folder beside the target.  A second job joins
the pieces of each order into its file, streamed by one task an order (so a file takes as long as its bytes
do, and memory for one block).  Files become visible by one rename of the folder when all are complete.
If a task fails, the writer removes the staging folder, and the target stays as it was.

Bytes never pass the driver: tasks report only the names of their lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ductlake.sources.spec_files import file_system

PIECES, FILES = "order_pieces", "order_files"
BLOCK = 4 << 20


@dataclass
class Written(WriterCommitMessage):
    """What one task has completed: the list of its pieces, or the number of its files."""

    name: str | None
    count: int


def file_name(order_id: object) -> str:
    return "order.xml" if order_id is None else f"order_{quote(str(order_id), safe='')}.xml"


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.staging = options["path"].rstrip("/")

    def folder(self, name: str) -> str:
        system, inside, _ = file_system(self.staging)
        system.create_dir(f"{inside}/{name}", recursive=True)
        return f"{inside}/{name}"

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        remove_folder(self.staging)


class PieceWriter(_Writer):
    """Rows (order_id, fragment_no, xml) sorted within a task -> pieces and a list of them."""

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _, _ = file_system(self.staging)
        folder, attempt, pieces = self.folder("pieces"), uuid.uuid4().hex, []
        stream = order = None
        for row in iterator:
            if stream is None or row.order_id != order:
                if stream is not None:
                    stream.close()
                order, name = row.order_id, f"{folder}/{attempt}-{len(pieces)}"
                stream = system.open_output_stream(name)
                pieces.append({"file": file_name(order), "first": row.fragment_no, "last": row.fragment_no, "piece": name})
            if row.fragment_no < pieces[-1]["last"]:
                raise ValueError(f"fragments of order {order} are not in order")
            pieces[-1]["last"] = row.fragment_no
            stream.write((row.xml or "").encode())
        if stream is None:
            return Written(None, 0)
        stream.close()
        listing = f"{self.folder('lists-open')}/{attempt}.json"
        with system.open_output_stream(listing) as out:
            out.write("".join(json.dumps(p) + "\n" for p in pieces).encode())
        return Written(listing, len(pieces))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Only the lists of tasks that count are kept; an attempt that was given up leaves pieces without a list."""
        system, inside, _ = file_system(self.staging)
        folder = self.folder("lists")
        for message in messages:
            if message is not None and message.name:
                system.move(message.name, f"{folder}/{message.name.rsplit('/', 1)[-1]}")


class FileWriter(_Writer):
    """Rows (file, pieces in order) -> the order's file; the folder becomes the target on commit."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.target = options["target"].rstrip("/")
        self.overwrite = options.get("overwrite", "false") == "true"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _, _ = file_system(self.staging)
        folder, count = self.folder("files"), 0
        for row in iterator:
            # A second attempt writes the same bytes anew under a name of its own and then takes the place.
            own = f"{self.folder('open')}/{uuid.uuid4().hex}"
            with system.open_output_stream(own) as out:
                for piece in row.pieces:
                    with system.open_input_stream(piece) as source:
                        while block := source.read(BLOCK):
                            out.write(block)
            system.move(own, f"{folder}/{row.file}")
            count += 1
        return Written(None, count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        folder = self.folder("files")
        system, target, _ = file_system(self.target)
        if system.get_file_info(target).type != fs.FileType.NotFound:
            if not self.overwrite:
                remove_folder(self.staging)
                raise FileExistsError(self.target)
            old = f"{self.folder('old')}/files"
            system.move(target, old)
        system.move(folder, target)
        remove_folder(self.staging)


def remove_folder(path: str) -> None:
    from pyarrow import fs

    system, inside, _ = file_system(path)
    if system.get_file_info(inside).type == fs.FileType.Directory:
        system.delete_dir(inside)


class OrderPieces(DataSource):
    """Option: path, the staging folder."""

    @classmethod
    def name(cls) -> str:
        return PIECES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PieceWriter(dict(self.options))


class OrderFiles(DataSource):
    """Options: path, the staging folder; target; overwrite."""

    @classmethod
    def name(cls) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(dict(self.options))


def ordered_pieces(spark: SparkSession, staging: str) -> DataFrame:
    """file, pieces (names in order) of all orders; pieces that overlap raise an error in the task that meets them."""
    listed = spark.read.schema("file string, first long, last long, piece string").json(f"{staging}/lists")
    grouped = listed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("first", "last", "piece"))).alias("p"))
    overlap = F.exists(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i)["first"] < F.get("p", i - 1)["last"])
    checked = F.when((F.size("p") > 1) & overlap, F.raise_error(F.concat(F.lit("pieces overlap: "), "file"))).otherwise(F.transform("p", lambda x: x["piece"]))
    return grouped.select("file", checked.alias("pieces"))


def write_order_files(documents: DataFrame, path: str, overwrite: bool = False) -> None:
    """K1: fragments (order_id, fragment_no, xml) as one file `order_<id>.xml` an order in the folder `path`.

    All files appear together or none does.  The path is a folder or a URI that pyarrow reaches.
    """
    spark = documents.sparkSession
    spark.dataSource.register(OrderPieces)
    spark.dataSource.register(OrderFiles)
    staging = f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    try:
        dealt = documents.select("order_id", "fragment_no", "xml").repartitionByRange("order_id", "fragment_no").sortWithinPartitions("order_id", "fragment_no")
        dealt.write.format(PIECES).option("path", staging).mode("append").save()
        _, inside, _ = file_system(staging)
        # Lists are empty where there is no order at all.
        system, _, _ = file_system(staging)
        system.create_dir(f"{inside}/lists", recursive=True)
        ordered_pieces(spark, staging).write.format(FILES).option("path", staging).option("target", path).option("overwrite", str(overwrite).lower()).mode("append").save()
    finally:
        remove_folder(staging)
