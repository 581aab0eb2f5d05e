"""The run history of each item in Spark's state store.

Only the newest state of an item in each run is kept, as an opaque text. Items are dealt
out to ``SHARES`` by a hash, and the histories of a share travel to a worker and back with
its rows: a call and a message for each item cost far more than the items. A micro-batch
reads and writes the shares of its items and no others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.state import GroupState

#: Newest states per item and run, as the store holds them for one share of the items.
HISTORY = "histories string"
#: Into how many shares the items are dealt. Checkpoints keep it: a stream that goes on
#: must not change it.
SHARES = 1 << 16


def newest_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest row per item and run of each batch, so a hot item sends few rows on."""
    for batch in batches:
        keys = [name for name in batch.schema.names if name not in ("id", "state")]
        frame = batch.to_pandas().sort_values("id").drop_duplicates(keys, keep="last")
        yield pa.RecordBatch.from_pandas(frame, schema=batch.schema, preserve_index=False)


def previous_states(runs: dict[int, tuple[int, str]]) -> dict[int, str | None]:
    """The state before each run."""
    before, found = None, {}
    for run in sorted(runs):
        found[run] = before
        before = runs[run][1]
    return found


def _plain(values: pd.Series) -> list:
    return [None if v is None or v != v else v for v in values.tolist()]


def run_history(
    key: tuple, rows: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Gives each run of the micro-batch, and each later one it changes, its state before.

    All items of one share come together; the columns before ``run_id`` name an item.
    ``again`` marks runs of earlier micro-batches whose rows need a new comparison.
    """
    here: dict[tuple, dict[int, tuple[int, str]]] = {}
    names: list[str] = []
    for frame in rows:
        names = [n for n in frame.columns if n not in ("share", "run_id", "id", "state")]
        items = zip(*[_plain(frame[n]) for n in names])
        for item, run, id_, text in zip(items, frame["run_id"].tolist(), frame["id"].tolist(), frame["state"].tolist()):
            runs = here.setdefault(item, {})
            if run not in runs or id_ > runs[run][0]:
                runs[run] = (id_, text)
    known = {tuple(item): {r: (i, t) for r, i, t in runs} for item, runs in (json.loads(state.get[0]) if state.exists else [])}
    told, changed = [], False
    for item, newer in here.items():
        old = known.get(item, {})
        merged = dict(old)
        for run, newest in newer.items():
            if run not in old or newest[0] > old[run][0]:
                merged[run] = newest
        before, after = previous_states(old), previous_states(merged)
        for run, previous in after.items():
            again = run in old and previous != before[run]
            if again or run in newer:
                told.append((*item, run, previous, again))
        changed |= merged != old
        known[item] = merged
    if changed:
        stored = [(item, [(r, i, t) for r, (i, t) in runs.items()]) for item, runs in known.items()]
        state.update((json.dumps(stored, ensure_ascii=False, separators=(",", ":")),))
    columns = [*(f"k{i}" for i in range(len(names))), "run_id", "previous", "again"]
    yield pd.DataFrame(dict(zip(columns, map(list, zip(*told)))))
