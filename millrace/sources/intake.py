"""Files handed over in a folder: claimed, read once per delivery, and moved when done."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from millrace.runtime import files_below, names_in, replace_file
from millrace.streaming.runs import drain


@dataclass(frozen=True)
class Intake:
    """Files of ``upload`` and its subfolders, each delivery read once and then moved to ``processed``,
    where it replaces an older one of the same place.

    A file source knows a path it has read and skips it for good, so a file that is delivered again
    under its old name would be lost.  Therefore files are first claimed: renamed into a folder of
    their own claim, where every delivery has a new path.  After the rows of all claims are written
    the files move on, oldest claim first, so the newest content stays.  An end of the job between
    the steps loses nothing: the next ``run`` reads claimed files that were not read, and moves all.

    ``upload`` and ``processed`` are on one file system and files are put in ``upload`` by rename.
    Names only pass through the driver; ``most`` bounds them per claim.  With ``flat`` files of all
    subfolders share one folder, and equal names replace each other.
    """

    spark: SparkSession
    upload: str
    processed: str
    pattern: str = "*"
    flat: bool = False
    most: int = 100_000

    @property
    def _claims(self) -> str:
        return f"{self.processed.rstrip('/')}.claims"

    def claim(self) -> int:
        """Take over what lies in ``upload``; gives the number of files."""
        named = [f for f in files_below(self.spark, self.upload) if fnmatch(f.rsplit("/", 1)[-1], self.pattern)]
        number = len(names_in(self.spark, self._claims))
        for f in named[: self.most]:
            replace_file(self.spark, f"{self.upload}/{f}", f"{self._claims}/{number:09d}/{f}")
        return len(named[: self.most])

    def lines(self, max_files: int | None = None) -> DataFrame:
        """A stream of ``line, file`` (the place below ``upload``) of all claims."""
        reader = self.spark.readStream.format("text").option("recursiveFileLookup", True)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        place = "regexp_extract(_metadata.file_path, '[.]claims/[0-9]{9}/(.*)$', 1)"
        return reader.load(self._claims).selectExpr("value AS line", f"url_decode(replace({place}, '+', '%2B')) AS file")

    def settle(self) -> None:
        """Move all claimed files; call it when their rows are written."""
        for f in files_below(self.spark, self._claims):
            place = f.split("/", 1)[1]
            place = place.rsplit("/", 1)[-1] if self.flat else place
            replace_file(self.spark, f"{self._claims}/{f}", f"{self.processed}/{place}")

    def run(self, writer_of: Callable[[DataFrame], DataStreamWriter], max_files: int | None = None) -> int:
        """Claim, write the rows of what is claimed, move the files; gives the number claimed."""
        n = self.claim()
        if names_in(self.spark, self._claims):
            drain(writer_of(self.lines(max_files)))
            self.settle()
        return n
