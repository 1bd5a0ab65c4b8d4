"""Tables kept between steps in the folder that all executors share, and keys of rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.lineage import forget, keep, let_go, shared_folder

#: Two independent hashes of a row's id and text; 64 bits alone would meet others at 10**10 rows.
KEY = ("_rk1", "_rk2")


def row_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    return [F.xxhash64(doc_id, text).alias(KEY[0]), F.xxhash64(F.lit(1), text, doc_id).alias(KEY[1])]


__all__ = ["KEY", "forget", "keep", "let_go", "row_keys", "shared_folder"]
