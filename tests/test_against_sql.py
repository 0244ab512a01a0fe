"""Queries against their SQL on rows that the given inputs do not hold."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from storyflow.plans import registry
from storyflow.plans import page_queries, record_queries, store_queries, text_queries  # noqa: F401

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def documents(folder, rows):
    """A documents table of rows (doc_id, text)."""
    folder.mkdir(exist_ok=True)
    cols = [[i for i, _ in rows], [t for _, t in rows], ["en"] * len(rows), [f"src{i % 3}" for i, _ in rows], [len(t or "") for _, t in rows]]
    pq.write_table(pa.table(cols, schema=DOCS), str(folder / "documents.parquet"))
    return str(folder)


def both(spark, sf, name, *tables):
    """The sorted rows of a query and of its SQL."""
    got = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    names = ", ".join(f'"{c}"' for c in got.columns)
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, con.sql(f"SELECT {names} FROM ({registry.SQL[name]})").fetchall()))


def test_path_dates_of_stories_years_ahead(spark, tmp_path):
    # 2026, 2082, 2099 to 2101, 2375
    sf = documents(tmp_path / "sf", [(i + k, "t") for i in (3, 17544, 512_000, 657_000, 666_000, 672_000, 675_000, 3_080_000) for k in range(10)])
    mine, want = both(spark, sf, "dt6_path_dates", "documents")
    assert mine == want


def test_named_path_dates_of_stories_years_ahead(spark, tmp_path):
    sf = documents(tmp_path / "sf", [(i + k, "t") for i in (3, 17544, 512_000, 657_000, 666_000, 672_000, 675_000, 3_080_000) for k in range(10)])
    mine, want = both(spark, sf, "dt6_named_path_dates", "documents")
    assert mine == want


def one_line(tmp_path):
    """Stories that are all title: the title alone, not the card's, is what their links say."""
    return documents(tmp_path / "sf", [(i, f"Some words of story {i} on a single line") for i in range(10_000, 10_900)])


def test_listing_rejection_of_stories_that_are_all_title(spark, tmp_path):
    mine, want = both(spark, one_line(tmp_path), "f19_listing_rejection", "documents")
    assert mine == want and any("navigation-first-page" in r for r in mine)


def test_source_analysis_of_stories_that_are_all_title(spark, tmp_path):
    mine, want = both(spark, one_line(tmp_path), "a15_source_analysis", "documents")
    assert mine == want


def test_page_titles_with_references_that_are_not_closed(spark, tmp_path):
    titles = ["Cut &amp;&amp;&amp", "A &amp; B", "AT&T &lt;b&gt; &quot;q&quot;", "x &amp;lt; y", "&amp &lt", "R&D; &", "a &notit; b &copy", "&#38 &"]
    sf = tmp_path / "sf"
    sf.mkdir()
    pq.write_table(pa.table({"page_id": list(range(len(titles))), "html": [f"<html><body><h1 class='t'>{t}</h1><p>x</p></body></html>" for t in titles]}), str(sf / "pages.parquet"))
    mine, want = both(spark, str(sf), "x5_page_titles", "pages")
    assert mine == want
