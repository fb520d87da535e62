"""Whole pages to numpy: nodes arrive sorted by page, and a page is never split between two calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that group what stands in them.
CONTAINERS = ("body", "div", "section", "article", "main", "aside", "nav", "header", "footer", "td", "th", "form", "table")
#: Elements inside a line of text.
INLINE = ("a", "abbr", "b", "cite", "code", "em", "i", "kbd", "mark", "q", "small", "span", "strong", "sub", "sup", "u")


def stream_pages(nodes: DataFrame, columns: list[str], run: Callable, schema: T.StructType, flags: DataFrame | None = None) -> DataFrame:
    """Calls run(table) with whole pages, in (page_id, node_id) order, and returns what it yields.

    One shuffle by page; pages are the unit of work, so hosts of any size spread over all tasks. flags: page_id, node_id of
    nodes that get flag = true; they travel as rows of their own through the same shuffle instead of a join.
    run takes a pyarrow Table with page_id, node_id, columns and flag, and returns a dict of arrays.
    """
    rows = nodes.select("page_id", "node_id", *columns, F.lit(False).alias("flag")).where("page_id is not null and node_id is not null")
    if flags is not None:
        empty = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in columns]
        rows = rows.unionByName(flags.select("page_id", "node_id", *empty, F.lit(True).alias("flag")))
    ordered = rows.repartition("page_id").sortWithinPartitions("page_id", "node_id", F.desc("flag"))
    names, flagged = schema.names, flags is not None

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        kept: list[pa.Table] = []
        rows_kept = 0

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            made = run(_merge_flags(table) if flagged else _first_of_each(table))
            if made is not None and len(made[names[0]]):
                yield from pa.table([pa.array(made[n], type=out.field(n).type) for n in names], schema=out).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            kept.append(pa.Table.from_batches([b]))
            rows_kept += b.num_rows
            if rows_kept < 60_000:
                continue
            whole = pa.concat_tables(kept)
            ids = whole["page_id"].to_numpy()
            cut = int(np.searchsorted(ids, ids[-1], "left"))
            if cut:
                yield from flush(whole.slice(0, cut))
                whole = whole.slice(cut)
            kept, rows_kept = [whole], whole.num_rows
        if kept:
            yield from flush(pa.concat_tables(kept))

    return ordered.mapInArrow(arrow, schema)


def _first_of_each(table: pa.Table) -> pa.Table:
    """Without repeated (page_id, node_id)."""
    p, n = table["page_id"].to_numpy(), table["node_id"].to_numpy()
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (n[1:] != n[:-1])
    return table if new.all() else table.filter(pa.array(new))


def _merge_flags(table: pa.Table) -> pa.Table:
    """Sets flag on the row after a flag row of the same node and drops the flag rows."""
    f = table["flag"].to_numpy(zero_copy_only=False)
    p, n = table["page_id"].to_numpy(), table["node_id"].to_numpy()
    start = np.ones(len(p), bool)
    start[1:] = (p[1:] != p[:-1]) | (n[1:] != n[:-1])
    group = np.cumsum(start) - 1
    flagged = np.zeros(group[-1] + 1, bool)
    flagged[group[f]] = True
    at = np.flatnonzero(~f)
    at = at[np.unique(group[at], return_index=True)[1]]
    return table.take(pa.array(at)).set_column(table.schema.get_field_index("flag"), "flag", pa.array(flagged[group[at]]))


class Pages:
    """The tree of the nodes of some whole pages as arrays. Expects page_id, node_id, parent_id, node_depth, tag, text, flag."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table.combine_chunks()
        self.page_id = self.table["page_id"].to_numpy()
        self.node_id = self.table["node_id"].to_numpy().astype(np.int64)
        n = len(self.page_id)
        new = np.ones(n, bool)
        new[1:] = self.page_id[1:] != self.page_id[:-1]
        self.start = np.flatnonzero(new)
        self.page = np.cumsum(new) - 1
        depth = self.table["node_depth"].fill_null(0).to_numpy().astype(np.int64)
        parent = self.table["parent_id"].fill_null(-1).to_numpy().astype(np.int64)
        # The place of the parent: node ids rise within a page, so one search over (page, node id) finds it; a missing parent is -1.
        key = self.page * (1 << 32) + self.node_id
        want = self.page * (1 << 32) + parent
        at = np.searchsorted(key, want)
        ok = (parent >= 0) & (at < n) & (key[np.minimum(at, n - 1)] == want) & (at != np.arange(n))
        self.parent = np.where(ok, at, -1)
        self.depth = depth
        tags = pc.dictionary_encode(self.table["tag"].fill_null("#text").combine_chunks())
        tags = tags.combine_chunks() if isinstance(tags, pa.ChunkedArray) else tags
        self.tag_names = tags.dictionary.to_pylist()
        self.tag = tags.indices.to_numpy()
        text = self.table["text"].fill_null("").combine_chunks()
        self.text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        self.flag = self.table["flag"].to_numpy(zero_copy_only=False)

    def tag_is(self, *names: str) -> np.ndarray:
        """For each node, whether its tag is one of the names."""
        return np.isin(np.array(self.tag_names, object), names)[self.tag] if len(self.tag_names) else np.zeros(0, bool)

    def inherit(self, own: np.ndarray, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """merge(value of the parent, own value) from the root down, one depth at a time."""
        out = own.copy()
        order = np.argsort(self.depth, kind="stable")
        ends = np.searchsorted(self.depth[order], np.arange(1, (self.depth.max(initial=0)) + 2), "left")
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            idx = order[a:b]
            idx = idx[self.parent[idx] >= 0]
            out[idx] = merge(out[self.parent[idx]], own[idx])
        return out

    def up(self, values: np.ndarray, default: int = -1) -> np.ndarray:
        """The value of the parent of each node."""
        return np.where(self.parent >= 0, values[self.parent], default)
