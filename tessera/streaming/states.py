"""Articles' states as keyed state with timers: attempts come as a stream, and a deferred article is ready again when its cool-down is over."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans.adapt import next_step
from .sink import write_batches

#: Milliseconds until a deferred article is tried again.
COOLDOWN_MS = 30 * 60 * 1000
#: Groups of articles, by a hash of their key; a stream's state can only be read with as many.
GROUPS = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = ("event", "status", "step", "attempts", "tokens_in", "tokens_out", "at_ms", "ready_ms", "steps")
STATE = "status string, step string, attempts long, tokens_in long, tokens_out long, at_ms long, rank long, ends long, steps map<string, long>"


class ArticleStates(StatefulProcessor):
    """List state of a group of articles: each article so far, when its cool-down ends and how often each step was taken. Timer: the first end of a cool-down in the group.

    Emits a row for each batch that brings attempts of an article ('attempt') and one when its cool-down is over ('ready').
    A call to the state costs as much for one article as for many, so that a group is read and written as a whole, once a batch.
    """

    def __init__(self, key: str, kind: str, cooldown_ms: int = COOLDOWN_MS):
        self.key, self.kind, self.cooldown_ms, self.row = key, kind, cooldown_ms, Row(key, *OUT)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.articles = handle.getListState("articles", f"article {self.kind}, {STATE}")

    def _out(self, article: object, event: str, held: list) -> Row:
        status, step, attempts, tokens_in, tokens_out, at, _, _, steps = held
        ready = at + self.cooldown_ms if status == "draft" else None
        return self.row(article, event, status, step, attempts, tokens_in, tokens_out, at, ready, ",".join(f"{k}:{n}" for k, n in sorted(steps.items())))

    def _read(self) -> dict[object, list]:
        return {article: list(held) for article, *held in self.articles.get()}

    def _keep(self, held: dict[object, list]) -> None:
        self.articles.put([(article, *x) for article, x in held.items()])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ends := [x[7] for x in held.values() if x[7] is not None]:
            self.handle.registerTimer(min(ends))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held, met, name = self._read(), {}, self.key
        for r in rows:
            article = r[name]
            if article not in met:
                met[article] = held.setdefault(article, [None, None, 0, None, None, -1, -1, None, {}])
            x, at, rank, step = met[article], r["at_ms"], r["rank"], r["step"]
            if (at, rank) > (x[5], x[6]):
                x[0], x[1], x[5], x[6] = r["status"], step, at, rank
            x[2] += 1
            for k, more in ((3, r["tokens_in"]), (4, r["tokens_out"])):
                if more is not None:
                    x[k] = more + (x[k] or 0)
            x[8][step] = x[8].get(step, 0) + 1
        for x in met.values():
            x[7] = x[5] + self.cooldown_ms if x[0] == "draft" else None
        self._keep(held)
        for article, x in met.items():
            yield self._out(article, "attempt", x)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        held = self._read()
        first, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        over = [(article, x) for article, x in held.items() if x[7] is not None and (x[7] <= first or x[7] < now)]
        for _, x in over:
            x[7] = None
        self._keep(held)
        for article, x in over:
            yield self._out(article, "ready", x)

    def close(self) -> None:
        pass


def schema(key: str, kind: str) -> str:
    return f"{key} {kind}, event string, status string, step string, attempts long, tokens_in long, tokens_out long, at_ms long, ready_ms long, steps string"


def article_states(attempts: DataFrame, key: str, at: str, rank: str, attempt: str = "attempt", delay: str = "10 minutes", cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """A stream of the articles' states (see ``schema``) from a stream of attempts with next_step's columns.

    An attempt's outcome is told by its columns before the state sees it; of attempts at one time the one with the larger
    ``rank`` (a long) is the later. An attempt later than the watermark (``delay``) is dropped. A draft's cool-down ends when the watermark
    passes it; an attempt before that starts it anew. State is a row an article, in GROUPS lists.
    """
    state = next_step(*(F.col(c) for c in ("ready", "answer_error", "check_error", "verdict_read", "failed_rules", attempt)))
    rows = attempts.withColumn("__state", state).select(key, F.col(at).cast("timestamp").alias("at"), F.col(rank).cast("long").alias("rank"), "__state.status", "__state.step", "tokens_in", "tokens_out")
    timed = rows.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    kind = attempts.schema[key].dataType.simpleString()
    grouped = timed.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(GROUPS))).groupBy("__group")
    return grouped.transformWithState(statefulProcessor=ArticleStates(key, kind, cooldown_ms), outputStructType=schema(key, kind), outputMode="Update", timeMode="EventTime")


def run_states(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream of ``article_states`` into the table at path; its state is kept in RocksDB beside the checkpoint."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, PROVIDER)
    try:
        return write_batches(stream, path, checkpoint)
    finally:
        conf.set(name, before) if before else conf.unset(name)
