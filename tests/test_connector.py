"""The connector as a data source: batch, skipped row groups, stream."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

from lekhya.sources import listing, saved_listing

PORTAL = listing.Portal(("gov.in",), ("/docs",), "GO", "FINANCE_TREASURY", "Government Order")
ROW = ("<table><tr><td>12/2024</td><td>05-06-2024</td><td>Order {0}</td>"
       "<td><a href='/docs/{0}.pdf'>PDF</a></td></tr></table>")


def saved(folder, name, ids):
    html = [None if i % 5 == 4 else ROW.format(i) if i % 2 else f"<a href='/docs/{i}.pdf'>D{i}</a>"
            for i in ids]
    table = pa.table({"page_id": pa.array(ids, pa.int64()), "html": html, "rows": ["x"] * len(ids),
                      "url": [f"https://gov.in/docs/list{i:03}" for i in ids]})
    pq.write_table(table, folder / name, row_group_size=4)


def read(spark, folder):
    saved_listing.register(spark)
    return spark.read.format("saved_listing").load(str(folder))


def items(df):
    return sorted(map(str, df.collect()))


def test_batch_equals_discovery(spark, tmp_path):
    saved(tmp_path, "a.parquet", list(range(10)))
    saved(tmp_path, "b.parquet", [3, 10, 11])
    plain = listing.discover(spark.read.parquet(str(tmp_path)).select("page_id", "url", "html"),
                             PORTAL)
    got = listing.listed_items(read(spark, tmp_path), PORTAL)
    assert items(got) == items(plain) and len(items(got)) == 11
    assert read(spark, tmp_path.as_uri()).rdd.getNumPartitions() == 4


def test_comparisons_skip_row_groups(spark, tmp_path):
    saved(tmp_path, "a.parquet", list(range(40)))
    df = read(spark, tmp_path).filter("page_id >= 33 AND url < 'https://gov.in/docs/list036'")
    assert [r["page_id"] for r in df.orderBy("page_id").collect()] == [33, 34, 35]
    assert df.rdd.getNumPartitions() == 1
    reader = saved_listing.ListingReader(str(tmp_path))
    assert len(list(reader.pushFilters([EqualTo(("page_id",), 9)]))) == 1
    assert [p.group for p in reader.partitions()] == [2]
    list(reader.pushFilters([GreaterThanOrEqual(("page_id",), 12)]))
    assert [p.path for p in reader.partitions()] == [""]
    assert read(spark, tmp_path).filter("page_id > 99").count() == 0


def test_empty_folder_and_missing_pages(spark, tmp_path):
    assert read(spark, tmp_path).count() == 0
    saved(tmp_path, "a.parquet", [4])
    row = read(spark, tmp_path).first()
    assert (row["rows"], row["links"]) == ([], [])
    with pytest.raises(Exception, match="nowhere"):
        read(spark, tmp_path / "nowhere").count()


def run_stream(spark, source, out, state):
    saved_listing.register(spark)
    pages = spark.readStream.format("saved_listing").load(str(source))
    found = listing.listed_items(pages, PORTAL)
    query = (found.writeStream.format("parquet").option("checkpointLocation", str(state))
             .trigger(availableNow=True).start(str(out)))
    query.awaitTermination(120)
    return spark.read.parquet(str(out))


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    saved(source, "a.parquet", list(range(10)))
    assert run_stream(spark, source, out, state).count() == 8
    saved(source, "b.parquet", list(range(10, 20)))
    got = run_stream(spark, source, out, state)
    assert items(got) == items(listing.listed_items(read(spark, source), PORTAL))
    assert items(run_stream(spark, source, out, state)) == items(got)
    saved(source, "aa.parquet", [20])
    saved(source, "c.parquet", [21])
    with pytest.raises(Exception, match="ascend"):
        run_stream(spark, source, out, state)
