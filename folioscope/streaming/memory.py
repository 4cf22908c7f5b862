"""Chat memory as a stateful stream: the same rows as ``with_history_tail``."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.operators.chat import PAGE_TURNS, history_entry, page_of

def history_stream(
    messages: DataFrame,
    session: str = "session_id",
    turn: str = "turn",
    page_turns: int = PAGE_TURNS,
    timeout_ms: int | None = None,
) -> DataFrame:
    """Each message with its ``page`` and ``history_tail``, the earlier turns of its page that have arrived.

    The state belongs to a page of a session, not to the session: it holds the messages of
    at most one page, and a long session is spread over many keys.  It goes when every turn of
    the page has been seen, or when nothing has arrived for ``timeout_ms``; a stream that runs on
    needs that time, since pages with gaps and the last pages of sessions would stay, while a run
    over what is available must do without, as Spark never ends one with such a time.  A turn that was already seen is a repetition and gives
    no row; a turn that arrives late gets the turns before it, and those after it had been told
    without it.  Messages without a turn have no page and follow each other as they arrive; their state
    goes by time alone.
    """
    paged = messages.select(
        session,
        turn,
        page_of(F.col(turn), page_turns).alias("page"),
        history_entry(F.col("role"), F.col("text")).alias("entry"),
    )
    output = T.StructType(
        [
            messages.schema[session],
            messages.schema[turn],
            T.StructField("page", T.LongType()),
            T.StructField("history_tail", T.StringType()),
        ]
    )

    def remember(key: tuple, chunks: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = {int(t): entry for t, entry in json.loads(state.get[0])} if state.exists else {}
        arrived = pd.concat(list(chunks))
        placed = not pd.isna(key[1])
        if placed:
            arrived = arrived.drop_duplicates(turn).sort_values(turn)
            arrived = arrived[~arrived[turn].isin(seen.keys())]
            places = [int(t) for t in arrived[turn]]
        else:
            places = list(range(len(seen), len(seen) + len(arrived)))
        seen.update(zip(places, arrived["entry"]))
        tails, tail = {}, ""
        for at in sorted(seen):
            tails[at] = tail
            tail += seen[at]
        if placed and len(seen) >= page_turns:
            state.remove()
        else:
            state.update((json.dumps(sorted(seen.items())),))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(
            {
                session: arrived[session],
                turn: arrived[turn],
                "page": key[1] if placed else None,
                "history_tail": [tails[at] for at in places],
            }
        )

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return paged.groupBy(session, "page").applyInPandasWithState(remember, output, "messages string", "append", timeout)
