"""Coverage plans: how many questions each section gets, and in which batch.

A request's sections are a bounded group (a handful of modules).  They are
gathered in the JVM as one array for each request, and Python plans many
requests to a batch.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from heapq import heapify, heapreplace
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import usable

CAP_PERCENT = 45


def allocated(lengths: list[int], count: int, cap_percent: int = CAP_PERCENT) -> list[int]:
    """Questions for each section in proportion to its length.

    Shares are rounded half to even and at least 1 where there are enough
    questions.  Running totals stay low enough that each later section can
    have one, as long as that is possible at all; what is left in the end
    goes to the longest section.  Then one pass in section order evens out
    what exceeds the cap onto the smallest other shares; a receiver may pass
    the cap after its own turn.
    """
    n, weights = len(lengths), [max(1, x) for x in lengths]
    least, whole = int(count >= n), sum(weights)

    def run_on(total: int, section: tuple[int, int]) -> int:
        weight, later = section
        ceiling = count - later if total + later < count else count
        return min(total + max(least, round(count * weight / whole)), ceiling)

    totals = list(accumulate(zip(weights, reversed(range(n)), strict=True), run_on, initial=0))
    shares = [b - a for a, b in pairwise(totals)]
    shares[lengths.index(max(lengths))] += count - totals[-1]
    return evened(shares, max(1, -(-count * cap_percent // 100))) if n > 1 else shares


def evened(shares: list[int], cap: int) -> list[int]:
    """Each share above the cap, in order, poured over onto whichever other is least, the first of equals."""
    for i in range(len(shares)):
        if (over := shares[i] - cap) > 0:
            others = [(s, j) for j, s in enumerate(shares) if j != i]
            heapify(others)
            for _ in range(over):
                heapreplace(others, (others[0][0] + 1, others[0][1]))
            for s, j in others:
                shares[j] = s
            shares[i] = cap
    return shares


def dealt(shares: list[int], sizes: list[int]) -> list[list[tuple[int, int]]]:
    """(section, questions) for each batch: sections queue up, give what a batch still needs and queue again with the rest."""
    queue = deque((i, s) for i, s in enumerate(shares) if s)
    plans: list[list[tuple[int, int]]] = []
    for size in sizes:
        plans.append([])
        while size and queue:
            section, has = queue.popleft()
            gives = min(has, size)
            plans[-1].append((section, gives))
            size -= gives
            if has > gives:
                queue.append((section, has - gives))
    return plans


def split(count: int, batch_size: int) -> list[int]:
    n = max(1, -(-count // batch_size))
    return [count // n + (i < count % n) for i in range(n)]


def planned(sections: list[tuple[str, int]], count: int, batch_size: int, offset: int = 0) -> list[tuple[int, str, int]]:
    """(batch, section, quota) for sections (id, characters) in order; batches are numbered from offset."""
    if not sections:
        return []
    shares = allocated([chars for _, chars in sections], count)
    quotas: Counter[tuple[int, str]] = Counter()
    for b, batch in enumerate(dealt(shares, split(count, batch_size)), offset):
        for i, gives in batch:
            quotas[b, sections[i][0]] += gives
    return [(b, s, q) for (b, s), q in quotas.items()]


def coverage_plan(chunks: DataFrame, count: int, batch_size: int = 10, least_chars: int = 45, offset: int = 0) -> DataFrame:
    """(request, batch, sectionId, quota) for chunks (request, ordinal, sectionId, chars), chars being the length of the whole chunk text."""
    kind = chunks.schema["request"].dataType.simpleString()
    gathered = usable(chunks, least_chars).groupBy("request").agg(F.sort_array(F.collect_list(F.struct("ordinal", "sectionId", "chars"))).alias("sections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x) for i, own in enumerate(batch.column(1).to_pylist()) for x in planned([(s["sectionId"], s["chars"]) for s in own], count, batch_size, offset)]
            at, numbers, ids, quotas = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(ids, pa.string()), pa.array(quotas, pa.int32())], names=["request", "batch", "sectionId", "quota"])

    return gathered.mapInArrow(run, f"request {kind}, batch int, sectionId string, quota int")
