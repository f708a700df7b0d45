"""Reading what a query has counted on its way."""

from __future__ import annotations

import threading

from pyspark.sql import Observation


def counted(observation: Observation, seconds: float = 60) -> int | None:
    """The count ``n`` of an observation whose query has run. Spark tells it by its listeners' queue, which drops events when
    it overflows; None then, after ``seconds``."""
    box: list[int] = []
    asked = threading.Thread(target=lambda: box.append(observation.get.get("n", 0)), daemon=True)
    asked.start()
    asked.join(seconds)
    return box[0] if box else None
