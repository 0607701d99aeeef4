"""A cache of question embeddings on a stream of questions: bounded, least recently used first out, with a time to live."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.embedding import embedded

#: Most questions held, and seconds that one is good for.
MOST, LIVE_SECONDS = 128, 300.0
RESULT = "shard long, event_id long, question string, hit boolean, vector array<float>"
STATE = "questions array<string>, stored array<double>, vectors array<array<float>>"


class Cache:
    """Questions with their embedding and when it was stored, the one used last at the end."""

    def __init__(self, most: int, live: float, dimensions: int, held: OrderedDict | None = None):
        self.most, self.live, self.dimensions, self.held = most, live, dimensions, held or OrderedDict()

    def ask(self, question: str, now: float) -> tuple[bool, list[float]]:
        """(hit, embedding): an expired one is made anew; being asked for doesn't prolong its life."""
        found = self.held.get(question)
        hit = found is not None and now - found[0] <= self.live
        if not hit:
            found = (now, embedded([question], self.dimensions, None)[0].tolist())
            self.held[question] = found
        self.held.move_to_end(question)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return hit, found[1]


def cached_embeddings(questions: DataFrame, shards: int = 64, most: int = MOST, live: float = LIVE_SECONDS, dimensions: int = 64) -> DataFrame:
    """(shard, event_id, question, hit, vector) of (event_id, created_at, question).

    Questions are dealt by hash into shards, each with a cache of ``most``; within a micro-batch (or a table) a shard's
    questions are taken in order of (created_at, event_id). The state of a shard is bounded by ``most`` embeddings.
    """
    rows = questions.filter("question IS NOT NULL").select("event_id", "created_at", "question").withColumn("shard", F.pmod(F.xxhash64("question"), F.lit(shards)))

    def answers(cache: Cache, part: pd.DataFrame, shard: int) -> pd.DataFrame:
        part = part.sort_values(["created_at", "event_id"])
        found = [cache.ask(q, t.timestamp()) for q, t in zip(part["question"], part["created_at"], strict=True)]
        return pd.DataFrame({"shard": shard, "event_id": part["event_id"], "question": part["question"], "hit": [h for h, _ in found], "vector": [v for _, v in found]})

    if not questions.isStreaming:
        return rows.groupBy("shard").applyInPandas(lambda key, part: answers(Cache(most, live, dimensions), part, key[0]), RESULT)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = OrderedDict()
        if state.exists:
            names, stored, vectors = state.get
            held = OrderedDict((q, (t, list(v))) for q, t, v in zip(names, stored, vectors, strict=True))
        cache = Cache(most, live, dimensions, held)
        yield answers(cache, pd.concat(list(parts)), key[0])
        state.update((list(cache.held), [t for t, _ in cache.held.values()], [v for _, v in cache.held.values()]))

    return rows.groupBy("shard").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)
