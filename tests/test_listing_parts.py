"""Parsed pages are handed on in parts, however many pages an Arrow batch has."""

import pandas as pd

from lekhya.sources import listing


class _Pages:
    """What parse_pages reads of a table, with the function that it passes on kept."""

    def __init__(self, df):
        self.schema, self.run = df.schema, None

    def mapInPandas(self, run, schema):
        self.run = run
        return self


def test_a_large_batch_is_parsed_in_parts(spark):
    n = 3 * listing.PAGES_AT_ONCE + 5
    html = '<table><tr><td>a<td><a href="x">b</a></table>'
    pages = _Pages(spark.createDataFrame([], "page_id long, html string"))
    run = listing.parse_pages(pages, "page_id").run
    batch = pd.DataFrame({"page_id": range(n), "html": [html] * n})
    parts = list(run(iter([batch, batch[:0]])))
    assert max(map(len, parts)) <= listing.PAGES_AT_ONCE
    assert [i for p in parts for i in p["page_id"]] == list(range(n))
    assert all(p["links"].map(len).eq(1).all() for p in parts)


def test_pages_of_a_table(spark):
    df = spark.createDataFrame([(i, f'<a href="u{i}">t</a>' if i % 7 else None)
                                for i in range(600)], "page_id long, html string").coalesce(1)
    rows = listing.parse_pages(df, "page_id").collect()
    assert len(rows) == 600 and sum(len(r["links"]) for r in rows) == 600 - 86
