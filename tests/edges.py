"""Variants of the smallest tables: empty, with rows of nulls, repeated rows, and extra columns whose names clash."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

SOURCE = Path("/root/testdata/sf0.001")
KEEP = {"record_id", "doc_id", "line_id", "model_id", "evaluation_id", "column_name", "source", "inclusion_status", "file_name", "feed", "delivered_at"}
CLASHING = ["kind", "member", "seq", "rec", "number", "quantity", "unit", "family_key", "day", "donor", "tokens", "shard", "points", "group_id", "root", "place", "ids", "spans", "_n", "at"]


def variant(name: str, target: Path) -> str:
    target.mkdir(parents=True, exist_ok=True)
    for p in SOURCE.glob("*.parquet"):
        t = pq.read_table(p)
        if name == "empty":
            t = t.slice(0, 0)
        elif name == "nulls":
            # one more row in which every column is null, and one in which only the ids are given
            blank = pa.table({f.name: pa.nulls(1, f.type) for f in t.schema}, schema=pa.schema([pa.field(f.name, f.type) for f in t.schema]))
            some = t.slice(0, 1)
            for i, f in enumerate(t.schema):
                if f.name not in KEEP:
                    some = some.set_column(i, f.name, pa.nulls(1, f.type))
            if p.stem not in ("mix_targets", "score_columns", "status_ranks"):
                t = pa.concat_tables([t.cast(blank.schema), blank, some.cast(blank.schema)])
        elif name == "clashing":
            for c in CLASHING:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array(["x"] * len(t)))
        elif name == "repeated":
            t = pa.concat_tables([t, t])
        pq.write_table(t, target / p.name)
    return str(target)


VARIANTS = ["empty", "nulls", "clashing", "repeated"]
