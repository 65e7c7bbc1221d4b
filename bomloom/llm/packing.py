"""Filling containers of fixed capacity with texts.

Best fit with conflicts: in each shard of documents the open containers are
ordered by what is left in them, and each carries bitmaps of the sources and of
the duplicate clusters it holds.  For each item, largest first, a successor
search over the residuals goes on until the tightest container that fits and
conflicts with nothing is found; else a new one is opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomloom.llm.tokens import TOKENIZER_FILE, sized
from bomloom.runtime import materialize

#: Documents packed together: enough to leave nearly no room, few enough for one task's memory.
DOCS_PER_SHARD = 10_000
#: Tokens of a shard on average: texts beyond the capacity become many pieces.
TOKENS_PER_SHARD = 50_000_000


class Shelf:
    """Open containers of one capacity, found by residual.

    ``level[r]`` lists the containers with ``r`` tokens left; bit ``r`` of
    ``filled`` tells that there are any, so the next residual that is large
    enough is the lowest set bit from there on.
    """

    def __init__(self, capacity: int, apart: list[int]):
        self.capacity, self.apart = capacity, apart
        self.level: dict[int, list[int]] = {}
        self.filled = 0
        self.sources: list[int] = []  # bitmap of sources in each container
        self.clusters: list[int] = []  # bitmap of duplicate clusters in each container
        self.items: list[int] = []

    def _successor(self, residual: int) -> int:
        rest = self.filled >> residual
        return residual + (rest & -rest).bit_length() - 1 if rest else -1

    def _file(self, box: int, residual: int) -> None:
        self.level.setdefault(residual, []).append(box)
        self.filled |= 1 << residual

    def _fits(self, box: int, source: int, cluster: int) -> bool:
        return not (self.sources[box] & self.apart[source]) and not (cluster >= 0 and self.clusters[box] >> cluster & 1)

    def _put(self, box: int, residual: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        self.sources[box] |= 1 << source
        if cluster >= 0:
            self.clusters[box] |= 1 << cluster
        self.items[box] += 1
        self._file(box, residual - size)
        return box, self.items[box] - 1

    def place(self, size: int, source: int, cluster: int, copies: int) -> list[tuple[int, int]]:
        """(container, place in it) for ``copies`` equal items, no two of one cluster in one container.

        One sweep over the residuals serves all copies: a container that has
        taken or refused one is out for the rest, so the sweep never turns back.
        """
        out: list[tuple[int, int]] = []
        residual = size
        while len(out) < copies and (residual := self._successor(residual)) >= 0:
            kept = []
            moved = []
            for box in self.level[residual]:
                if len(out) + len(moved) < copies and self._fits(box, source, cluster):
                    moved.append(box)
                    if cluster < 0:
                        kept += self.level[residual][len(kept) + len(moved) :]
                        break
                else:
                    kept.append(box)
            self.level[residual] = kept
            if not kept:
                self.filled &= ~(1 << residual)
            out += [self._put(box, residual, size, source, cluster) for box in moved]
            if cluster >= 0 or not moved:
                residual += 1
            else:
                residual = size  # a single item: the next one starts anew
        while len(out) < copies:
            self.sources.append(0)
            self.clusters.append(0)
            self.items.append(0)
            out.append(self._put(len(self.items) - 1, self.capacity, size, source, cluster))
        return out


_PACKED = pa.schema(
    [("pack_id", pa.int32()), ("container_id", pa.int64()), ("item_no", pa.int32()), ("doc_id", pa.int64()), ("part_no", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64())]
)
_PACKED_DDL = "pack_id int, container_id bigint, item_no int, doc_id bigint, part_no int, start_token bigint, n_tokens bigint"


def pack_shard(rows: list[dict], pack_id: int, capacity: int, apart: dict[str, set[str]], first_id: int) -> list[dict]:
    """Pack one shard's documents (doc_id, source, n_tokens, copy) into containers of one capacity."""
    names = sorted({r["source"] or "" for r in rows})
    code = {s: i for i, s in enumerate(names)}
    bits = [sum(1 << code[o] for o in apart.get(s, ()) if o in code) for s in names]
    counts: dict = {}
    for r in rows:
        counts[r["copy"]] = counts.get(r["copy"], 0) + 1
    cluster = {c: i for i, c in enumerate(k for k, n in counts.items() if n > 1)}
    items = []
    for r in rows:
        size, whole = r["n_tokens"], r["n_tokens"] // capacity if r["n_tokens"] > capacity else 0
        for part in range(whole):
            items.append((capacity, r["doc_id"], part, part * capacity, r))
        if size > whole * capacity or whole == 0:
            items.append((size - whole * capacity, r["doc_id"], whole, whole * capacity, r))
    shelf = Shelf(capacity, bits)
    key = lambda x: (-x[0], cluster.get(x[4]["copy"], -1), code[x[4]["source"] or ""])
    out = []
    items.sort(key=lambda x: (*key(x), x[1], x[2]))
    for (size, group, source), equal in groupby(items, key=key):
        run = list(equal)
        # pieces of one split document may share a container, whole copies may not
        places = shelf.place(-size, source, group, len(run))
        for (box, at), (n, doc, part, start, _) in zip(places, run, strict=True):
            out.append({"pack_id": pack_id, "container_id": first_id + box, "item_no": at, "doc_id": doc, "part_no": part, "start_token": start, "n_tokens": n})
    return out


def _pack(batches: Iterator[pa.RecordBatch], apart: dict[str, set[str]]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    shard = None

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            out = pack_shard(held, held[0]["pack_id"], held[0]["capacity"], apart, held[0]["shard"] << 32)
            for at in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_pylist(out[at : at + 20_000], schema=_PACKED)

    for batch in batches:
        for r in batch.to_pylist():
            if (r["pack_id"], r["shard"]) != shard:
                yield from flush()
                shard, held = (r["pack_id"], r["shard"]), []
            r["copy"] = (r.pop("copy1"), r.pop("copy2"))
            held.append(r)
    yield from flush()


def pack(documents: DataFrame, sizes: DataFrame, apart: dict[str, set[str]] | None = None, tokenizer: str = TOKENIZER_FILE, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """``pack_id, container_id, item_no, doc_id, part_no, start_token, n_tokens`` for each size of ``sizes``.

    ``sizes`` (pack_id, capacity_tokens) is a small table of parameters.  Every
    document is in containers of every capacity.  A text is split only if it
    exceeds the capacity: into full pieces, which fill containers of their own,
    and a rest.  Copies of one text never share a container, nor do sources that
    ``apart`` keeps from each other (it must be symmetric).

    Documents are spread over shards by their id, so copies of one text, however
    many, meet in no single task.  Null and empty texts are items without tokens;
    repeated rows are copies; an empty table gives an empty result.
    """
    docs = materialize(sized(documents.where("doc_id is not null"), tokenizer), "pack-sizes")
    size = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    shards = max(1, -(-size.docs // docs_per_shard), -(-size.tokens // TOKENS_PER_SHARD))
    options = [(r.pack_id, r.capacity_tokens) for r in sizes.select("pack_id", "capacity_tokens").where("capacity_tokens > 0").collect()]
    if not options:
        return docs.sparkSession.createDataFrame([], _PACKED_DDL)
    each = F.explode(F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in options]))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards))
    rows = docs.withColumn("shard", shard).withColumn("p", each).select("p.pack_id", "p.capacity", "shard", "doc_id", "source", "n_tokens", "copy1", "copy2")
    placed = rows.repartition(shards * len(options), "pack_id", "shard").sortWithinPartitions("pack_id", "shard")
    symmetric = {s: set(o) for s, o in (apart or {}).items()}
    for s, others in list(symmetric.items()):
        for o in others:
            symmetric.setdefault(o, set()).add(s)
    return placed.mapInArrow(partial(_pack, apart=symmetric), _PACKED_DDL)


def summary(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pack_id, containers, items, tokens, fill``: how full the containers are."""
    boxes = packed.groupBy("pack_id", "container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    sums = boxes.groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    full = sums.join(F.broadcast(sizes.select("pack_id", "capacity_tokens")), "pack_id")
    return full.select("pack_id", "containers", "items", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
