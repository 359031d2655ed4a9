"""A request folder served by a stream: JSON requests in, one JSON response file for each batch out."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def serve(spark: SparkSession, requests: str, responses: str, checkpoint: str, schema: str, answer: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Answer each request file as it appears. `answer` maps a batch of requests to responses, which
    are written under the batch's number, so that a batch that is done again after a failure
    replaces its own files. With `once`, serve what is there and stop; else run until stopped."""

    def batch(df: DataFrame, number: int) -> None:
        answer(df).write.mode("overwrite").json(f"{responses}/batch={number}")

    writer = spark.readStream.schema(schema).json(requests).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Client:
    """The other side of a request folder: numbered request files, answers read once as they appear, in the
    order of the requests, and a request to keep the server alive after half its time-out without one."""

    def __init__(self, folder: str, timeout: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.folder, self.timeout, self.clock = folder, timeout, clock
        self.number, self.pending, self.next_alive = 1, {}, None

    def send(self, request: dict, callback: Callable[[dict], None] | None = None) -> int:
        number, self.number = self.number, self.number + 1
        path = os.path.join(self.folder, f"request-{number}.json")
        with open(path + ".tmp", "w", encoding="utf-8") as f:
            json.dump(request, f)
        os.replace(path + ".tmp", path)  # the server meets whole files alone
        self.pending[number] = callback
        self.next_alive = self.clock() + self.timeout / 2
        return number

    def poll(self) -> dict[int, dict]:
        """Answers that came since; those that tell of an error are not handed to their callback."""
        found = {}
        for number in sorted(self.pending):
            path = os.path.join(self.folder, f"response-{number}.json")
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    found[number] = json.load(f)
                os.remove(path)
                callback = self.pending.pop(number)
                if callback and not found[number].get("ErrorMessage"):
                    callback(found[number])
        if self.next_alive is not None and self.clock() > self.next_alive:
            self.send({"$type": "KeepAlive"})
        return found


def exchange(prompts: DataFrame, answers: DataFrame, key: str, prompt: str, answer: str) -> DataFrame:
    """Prompts that a person is to answer by putting text in the place of each: `key, content, done`. Content
    is the answer where there is one that isn't blank or the prompt itself, else still the prompt."""
    told = answers.where(F.trim(answer) != "").groupBy(key).agg(F.max(answer).alias("_a"))
    joined = prompts.join(told, key, "left")
    done = F.col("_a").isNotNull() & (F.col("_a") != F.col(prompt))
    return joined.select(key, F.when(done, F.col("_a")).otherwise(F.col(prompt)).alias("content"), F.coalesce(done, F.lit(False)).alias("done"))
