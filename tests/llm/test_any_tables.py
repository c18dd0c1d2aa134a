"""The queries of the subpackage on empty tables, and on tables with null rows and foreign columns."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.llm.queries import QUERIES

FOREIGN = "n of file hash score line_no bundle start words cosine near other place key q i v w x y space cell list home members rep top total hits library reason repo folder passage item_id standing vec".split()


@pytest.fixture(scope="module")
def tables(small, tmp_path_factory):
    """Folders of empty tables, and of tables with null rows and more columns."""
    empty, dirty = (tmp_path_factory.mktemp(n) for n in ("empty", "dirty"))
    for file in glob.glob(f"{small}/*.parquet"):
        table = pq.read_table(file).replace_schema_metadata(None)
        pq.write_table(table.slice(0, 0), empty / os.path.basename(file))
        schema = pa.schema([c.with_nullable(True) for c in table.schema])
        table = pa.concat_tables([table.cast(schema), pa.table({c.name: pa.nulls(3, c.type) for c in schema}, schema=schema)])
        for name in FOREIGN:
            if name not in table.column_names:
                table = table.append_column(name, pa.array(["7"] * table.num_rows))
        pq.write_table(table, dirty / os.path.basename(file))
    return str(empty), str(dirty)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, tables[0]).collect() == []


@pytest.mark.parametrize("name", ["p1_redacted", "p2_pieces", "p4_found", "p6_ranking", "p7_reasons", "p8_free_room", "p9_spans", "p10_found"])
def test_null_rows_and_foreign_columns(spark, small, tables, name):
    own, dirty = (sorted(map(str, QUERIES[name](spark, folder).collect())) for folder in (small, tables[1]))
    assert own == dirty and own
