"""Mixing overlapping sources to target weights through a min-cost flow.

Documents are first aggregated by membership pattern (the set of sources they belong to). A
flow network then routes each pattern's words to the sources' targets: a pattern offers its
words up to `max_repeats` times, each further pass at a higher cost, so repetition is spread
convexly. The solved flow says how many whole passes every pattern makes and how many words
the last, partial pass takes; that pass takes the documents with the smallest seeded hashes,
the last few chosen so that their sizes meet the amount.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, WORD_PATTERN, boxed, cut, text_of, unboxed

#: Documents that the exact choice at the end of a partial pass looks at, on average.
LAST_DOCUMENTS = 500
#: Patterns up to which the plan's rows are broadcast (some hundred bytes each).
BROADCAST_PATTERNS = 50_000
#: Cells of a pattern that are summed up first, so that no task orders all cells of a hot one.
CELLS_TOGETHER = 1000
#: Source weights in code-point order, repeating.
WEIGHTS = (1, 2, 3)


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> dict[str | None, float]:
    """Share all words by weight; a source stops at cap times its size and the excess is shared
    again by weight among the others."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {s: float(full[s]) if s in full else float(share[s]) for s in names}
        full |= {s: cap * sizes[s] for s in over}


def min_cost_flow(supply: dict[object, int], members: dict[object, tuple], targets: dict[object, int], repeats: int) -> dict[tuple[object, int, object], int]:
    """Words of each (pattern, pass, source). Successive shortest paths; a pass costs its number.

    Nodes: start, one per pattern, one per source, end. Arcs start -> pattern exist once for
    each pass with the pattern's words as capacity.
    """
    graph: dict[object, list[list]] = defaultdict(list)

    def arc(a, b, capacity, cost, label=None):
        graph[a].append([b, capacity, cost, len(graph[b]), label])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1, None])

    for p in sorted(supply, key=repr):
        for k in range(1, repeats + 1):
            arc("start", ("p", p), supply[p], k, (p, k))
        for s in members[p]:
            arc(("p", p), ("s", s), supply[p] * repeats, 0, (p, s))
    for s in sorted(targets, key=repr):
        arc(("s", s), "end", targets[s], 0)
    potential: dict[object, int] = defaultdict(int)
    while True:
        best, came, heap, tie = {"start": 0}, {}, [(0, 0, "start")], 0
        while heap:
            cost, _, a = heapq.heappop(heap)
            if cost > best[a]:
                continue
            for i, (b, capacity, c, _, _) in enumerate(graph[a]):
                new = cost + c + potential[a] - potential[b]
                if capacity > 0 and new < best.get(b, 1 << 60):
                    best[b], came[b] = new, (a, i)
                    heapq.heappush(heap, (new, tie := tie + 1, b))
        if "end" not in best:
            break
        far = max(best.values())
        for node in list(graph):
            potential[node] += best.get(node, far)
        amount, node = 1 << 62, "end"
        while node != "start":
            a, i = came[node]
            amount, node = min(amount, graph[a][i][1]), a
        node = "end"
        while node != "start":
            a, i = came[node]
            graph[a][i][1] -= amount
            graph[node][graph[a][i][3]][1] += amount
            node = a
    # Passes fill in order of cost; the sources of a pattern take their words in that order too.
    flow = {}
    for p in supply:
        passes = [graph[b][back][1] for b, _, _, back, label in graph["start"] if label and label[0] == p]
        wants = [[label[1], graph[b][back][1]] for b, _, _, back, label in graph[("p", p)] if label]
        for k, room in enumerate(passes, 1):
            for want in wants:
                if moved := min(room, want[1]):
                    flow[p, k, want[0]] = flow.get((p, k, want[0]), 0) + moved
                    room, want[1] = room - moved, want[1] - moved
    return flow


def last_choice(pdf: pd.DataFrame, amount: int) -> pd.DataFrame:
    """The ids whose sizes come closest to amount: largest first while they fit, then the
    smallest left if that brings the sum closer. Rows that repeat an id go together."""
    units = pdf.groupby("doc_id", dropna=False, as_index=False)["size"].sum().sort_values(["size", "doc_id"], ascending=[False, True])
    chosen, left = [], amount
    for doc_id, size in zip(units["doc_id"], units["size"], strict=True):
        chosen.append(size <= left)
        left -= size if size <= left else 0
    units["taken"] = chosen
    rest = units[~units["taken"] & (units["size"] > 0)]
    if len(rest) and abs(rest["size"].iloc[-1] - left) < left:
        units.loc[rest.index[-1], "taken"] = True
    return units[units["taken"]][["doc_id"]]


def annotate(docs: DataFrame, sources: Column, seed: int) -> DataFrame:
    none = F.array(F.lit(None).cast("string"))
    named = F.array_sort(F.array_distinct(F.coalesce(sources, none)))
    size = word_count(text_of())
    # The text takes part, so rows without an id, or with one id, fall in different cells.
    order = F.xxhash64(F.col("doc_id").cast("long"), text_of(), F.lit(seed)) / F.lit(2.0**64) + 0.5
    return docs.withColumns({"_pattern": F.when(F.size(named) > 0, named).otherwise(none), "_size": size, "_u": order})


class Mix:
    """A solved mix of docs.

    sources is an array column of a row's sources (a null or empty array counts as the one
    source null); targets maps {pattern: words} to {source: words wanted}. Only sums for each
    pattern come to the driver, so their number is that of the distinct patterns.
    """

    def __init__(self, docs: DataFrame, sources: Column, targets, repeats: int = 3, seed: int = 0):
        spark, self.sources, self.seed = docs.sparkSession, sources, seed
        self.rows = cut(annotate(docs, sources, seed).select(F.col("doc_id").cast("long").alias("doc_id"), "_pattern", "_size", "_u"), "mix-rows")
        held = [(tuple(r["_pattern"]), r.n, r.words) for r in self.rows.groupBy("_pattern").agg(F.count("*").alias("n"), F.sum("_size").alias("words")).collect()]
        self.words = {p: w for p, _, w in held}
        self.wanted = targets(self.words)
        self.flow = min_cost_flow(self.words, {p: p for p in self.words}, {s: round(t) for s, t in self.wanted.items()}, repeats)
        plan = []
        for p, n, w in held:
            taken = sum(v for (q, _, _), v in self.flow.items() if q == p)
            plan.append((list(p), *(divmod(taken, w) if w else (1, 0)), max(1, n // LAST_DOCUMENTS)))
        # One pattern may hold a third of all rows, so rows aren't dealt out by it: the plan goes
        # to them, after a check of its size.
        self.to_rows = F.broadcast if len(held) <= BROADCAST_PATTERNS else lambda df: df
        self.plan = self.to_rows(spark.createDataFrame(plan, "_p array<string>, _whole long, _part long, _cells long"))
        cells = self._with_cells(self.rows).where("_part > 0").groupBy("_pattern", "_part", "_cell").agg(F.sum("_size").alias("words"))
        cells = cut(cells.withColumn("_super", F.floor(F.col("_cell") / CELLS_TOGETHER)), "mix-cells")

        def where_reached(rows: DataFrame, order: str) -> DataFrame:
            """Of each pattern, the row in whose order its partial pass ends, and the words before."""
            upto = F.sum("words").over(Window.partitionBy("_pattern").orderBy(order)) + F.col("_before")
            return rows.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_part")) & (F.col("_upto") - F.col("words") < F.col("_part")))

        # Two levels: first the group of cells, then the cell of its seeded order.
        groups = cells.groupBy("_pattern", "_part", "_super").agg(F.sum("words").alias("words")).withColumn("_before", F.lit(0).cast("long"))
        group = where_reached(groups, "_super").select(F.col("_pattern").alias("_q"), F.col("_super").alias("_s"), (F.col("_upto") - F.col("words")).alias("_before"))
        inner = cells.join(self.to_rows(group), F.col("_pattern").eqNullSafe(F.col("_q")) & (F.col("_super") == F.col("_s")))
        ends = where_reached(inner, "_cell")
        self.ends = cut(ends.select(F.col("_pattern").alias("_q"), F.col("_cell").alias("_end"), (F.col("_part") - F.col("_upto") + F.col("words")).alias("_left")), "mix-ends")
        self.ends = self.to_rows(self.ends)

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            return last_choice(pdf, int(pdf["_left"].iloc[0])).assign(_extra=True)

        last = self._with_ends(self._with_cells(self.rows)).where("_cell = _end").select("doc_id", "_pattern", F.col("_size").alias("size"), "_left")
        self.extra = cut(last.groupBy("_pattern").applyInPandas(choose, "doc_id long, _extra boolean").withColumnRenamed("doc_id", "_id"), "mix-extra")
        if self.extra.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            self.extra = F.broadcast(self.extra)

    def _with_cells(self, rows: DataFrame) -> DataFrame:
        rows = rows.join(self.plan, F.col("_pattern").eqNullSafe(F.col("_p"))).drop("_p")
        return rows.withColumn("_cell", F.least(F.floor(F.col("_u") * F.col("_cells")), F.col("_cells") - 1))

    def _with_ends(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.ends, F.col("_pattern").eqNullSafe(F.col("_q")), "left").drop("_q")

    def copies(self, rows: DataFrame) -> DataFrame:
        """Annotated rows with `copies`, the times that the mix takes each."""
        rows = self._with_ends(self._with_cells(rows)).join(self.extra, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_cell") == F.col("_end")), "left")
        more = (F.coalesce(F.col("_cell") < F.col("_end"), F.lit(False)) | F.coalesce("_extra", F.lit(False))).cast("int")
        return rows.withColumn("copies", F.col("_whole") + more)

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with all their columns, each row as often as the mix takes it (rows without
        words as often as its source's whole passes, once at least)."""
        needed = ["doc_id", "text", self.sources.alias("_sources")]
        rows = self.copies(annotate(boxed(docs, *needed), F.col("_sources"), self.seed))
        times = F.when(F.col("_size") == 0, F.greatest("copies", F.lit(1))).otherwise(F.col("copies")).cast("int")
        again = rows.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        return unboxed(again)


def single_source(words: dict[tuple, int]) -> dict[str | None, float]:
    return source_targets({p[0]: w for p, w in words.items()})


def one_source(column: str = "source") -> Column:
    return F.array(F.col(column).cast("string"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for documents with one source each.

    A null text has size 0 and is taken 0 words; a null source is a source of its own, last in
    order; repeated rows count apart; an empty table gives no rows; other columns are ignored.
    """
    mix = Mix(docs, one_source(), single_source)
    listed = [(list(p), w, mix.wanted[p[0]]) for p, w in mix.words.items()]
    listed = docs.sparkSession.createDataFrame(listed, "_s array<string>, source_size long, target double")
    rows = mix.copies(mix.rows).join(mix.to_rows(listed), F.col("_pattern").eqNullSafe(F.col("_s")))
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs, each row as often as the mix to its sources' targets takes it.

    Null and empty texts have no words and stay once at least; a null source is one of its own;
    repeated rows count apart; an empty table gives an empty one; columns stay as they are.
    """
    return Mix(docs, one_source(), single_source).apply(docs)
