"""Reading Arrow columns of texts in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch of texts, at the most.
BATCH_ROWS = 1000
#: Texts that are Python objects at a time.
AT_A_TIME = 250


def few_rows(df: DataFrame) -> DataFrame:
    """df, in a session that sends texts to Python in batches of no more than BATCH_ROWS."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, a few at a time, so that a batch of long ones is not held twice."""
    for at in range(0, len(column), AT_A_TIME):
        yield from column.slice(at, AT_A_TIME).to_pylist()


class Known(dict):
    """A table of bounded size for a worker: what is asked for is young; when the young are too many they grow old, and the
    old of before go. So what is in use stays, however many keys pass by."""

    def __init__(self, make: Callable[[str], object], young: int) -> None:
        super().__init__()
        self.make, self.young, self.old = make, young, {}

    def __missing__(self, key: str) -> object:
        if len(self) >= self.young:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value
