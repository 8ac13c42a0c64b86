"""What each owner knows, kept up as a stream goes: facts with an index by entity, feelings, and impressions of people."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quern.streaming import replay

#: Fixed value: impressions of a person that are kept, and feelings that are shown.
RECENT = 5
CHANGED = "owner string, kind string, name string, value string, n long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KnowledgeState(StatefulProcessor):
    """State of one owner. A fact lies under its own number, and each entity has the numbers of its facts, so that an update
    touches what it names only; `days` after an owner's last observation everything of theirs goes."""

    def __init__(self, days: float | None = None) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")
        self.facts = handle.getMapState("facts", "id long", "content string, source string, session string, at double")
        self.entities = handle.getMapState("entities", "name string", "ids array<long>")
        self.feelings = handle.getListState("feelings", "content string, at double")
        self.people = handle.getMapState("people", "name string", "seen array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "content"], kind="stable")
        touched, seen, felt = set(), {}, []
        n = self.count.get()[0] if self.count.exists() else 0
        for kind, names, source, session, content, at in zip(*(batch[x] for x in ("kind", "names", "source", "session", "content", "at")), strict=True):
            if kind == "fact":
                self.facts.updateValue((n,), (content, source, session, float(at)))
                for name in names:
                    ids = list(self.entities.getValue((name,))[0]) if self.entities.containsKey((name,)) else []
                    self.entities.updateValue((name,), ([*ids, n],))
                    touched.add(name)
                n += 1
            elif kind == "feeling":
                felt.append((content, float(at)))
            elif content and content.strip():
                for name in names:
                    known = seen.setdefault(name, list(self.people.getValue((name,))[0]) if self.people.containsKey((name,)) else [])
                    if content.strip() not in known:
                        known.append(content.strip())
        self.count.update((n,))
        found = []
        for name in sorted(touched):
            ids = self.entities.getValue((name,))[0]
            latest = max(((self.facts.getValue((i,))[3], i) for i in ids))[1]
            found.append((key[0], "entity", name, self.facts.getValue((latest,))[0], len(ids)))
        for name, known in sorted(seen.items()):
            self.people.updateValue((name,), (known[-RECENT:],))
            found.append((key[0], "person", name, "\n".join(known[-RECENT:]), len(known[-RECENT:])))
        if felt:
            self.feelings.appendList(felt)
            every = sorted(self.feelings.get(), key=lambda x: -x[1])
            found.append((key[0], "feelings", "", "\n".join(x[0] for x in every[:RECENT]), len(every)))
        if self.days is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(batch["event_time"].max().timestamp() * 1000 + self.days * 86_400_000))
        yield pd.DataFrame(found, columns=[x.split()[0] for x in CHANGED.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.count, self.facts, self.entities, self.feelings, self.people):
            state.clear()
        yield pd.DataFrame({"owner": [key[0]], "kind": ["forgotten"], "name": [""], "value": [""], "n": [0]})

    def close(self) -> None:
        pass


def knowledge_changes(observations: DataFrame, days: float | None = None) -> DataFrame:
    """owner, kind, name, value, n of what each batch changes. observations: owner, kind (fact, feeling or impression), names
    (of the entities of a fact, or of the person), source, session, content, at (days), and where owners are forgotten after
    `days` without one, event_time with a watermark.

    kind `entity`: the latest of its facts (by at, then as learned) and how many; `person`: the last five impressions in order,
    repeats passed over; `feelings`: the five latest, newest first, and how many; `forgotten`: nothing is left. Within a batch
    observations go by at, then content. A restart goes on from the stored state.
    """
    return observations.groupBy("owner").transformWithStateInPandas(KnowledgeState(days), CHANGED, "Update", "None" if days is None else "EventTime")


def run_with_state(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """replay.run_available() with the state store that maps, lists and timers need, set for this query only."""
    conf, name = changes.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)
    try:
        return replay.run_available(changes, sink, checkpoint, "update")
    finally:
        conf.set(name, before)
