"""Adapters from the star tables to the record shapes of the table corpus.

Each adapter cuts a star table into small tables by blocks of its key, so the number
of tables grows with the data while a single table stays within the cell limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PART_BLOCK = 20
CUSTOMER_BLOCK = 25
SUPPLIER_BLOCK = 10
PAGE_BLOCK = 30


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, title: str, key: str, block: int, columns: dict[str, str]) -> DataFrame:
    number = F.col(key).cast("bigint")
    index = F.floor(number / block).cast("bigint")
    return df.select(
        F.concat(F.lit(f"{title}_"), index.cast("string")).alias("table_id"),
        F.lit(title).alias("title"),
        F.array(*[F.lit(h) for h in columns]).alias("header"),
        (number % block).cast("int").alias("row_no"),
        F.array(*[F.col(c).cast("string") for c in columns.values()]).alias("values"),
    )


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per table row: parts, customers and suppliers, with different headers."""
    part = _rows(
        load(spark, sf_dir, "part"), "part", "p_partkey", PART_BLOCK,
        {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size",
         "price": "p_retailprice"},
    )
    customer = _rows(
        load(spark, sf_dir, "customer"), "customer", "c_custkey", CUSTOMER_BLOCK,
        {"name": "c_name", "nation": "c_nationkey", "segment": "c_mktsegment",
         "balance": "c_acctbal"},
    )
    supplier = _rows(
        load(spark, sf_dir, "supplier"), "supplier", "s_suppkey", SUPPLIER_BLOCK,
        {"name": "s_name", "nation": "s_nationkey", "balance": "s_acctbal"},
    )
    return part.unionByName(customer).unionByName(supplier)


def rows_to_tables(rows: DataFrame) -> DataFrame:
    """Table rows to nested tables. Only for tables within the cell limit."""
    grouped = rows.groupBy("table_id").agg(
        F.first("title").alias("title"),
        F.first("header").alias("header"),
        F.array_sort(F.collect_list(F.struct("row_no", "values"))).alias("_r"),
    )
    return grouped.withColumn("rows", F.transform("_r", lambda r: r["values"])).drop("_r")


def corpus_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested tables: table_id, title, header, rows."""
    return rows_to_tables(corpus_rows(spark, sf_dir))


def _td(c: Column | str, attrs: str | Column = "") -> Column:
    attrs = F.lit(attrs) if isinstance(attrs, str) else attrs
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("<td"), attrs, F.lit(">"), c.cast("string"), F.lit("</td>"))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with tables, one page per block of customers.

    Per page: a sortable table with a two-row header whose segment cells span the
    rows of their customers; a second sortable table that must be ignored; a
    collapsible table with column spans; in every third page a collapsed table with
    one short row, and in every fifth page its span is not a number.
    """
    c = load(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / PAGE_BLOCK).cast("bigint").alias("page_id"),
        "c_custkey", "c_mktsegment", "c_nationkey",
        F.col("c_acctbal").cast("string").alias("balance"),
    )
    segment = c.groupBy("page_id", "c_mktsegment").agg(
        F.array_sort(F.collect_list(F.struct("c_custkey", "c_nationkey", "balance"))).alias("m")
    )
    span = F.concat(F.lit(' rowspan="'), F.size("m").cast("string"), F.lit('"'))
    spanned = F.transform(
        "m",
        lambda r, i: F.concat(
            F.lit("<tr>"),
            F.when(i == 0, _td(F.concat(F.lit(" <b>"), F.col("c_mktsegment"), F.lit("</b>&nbsp;")), span))
            .otherwise(F.lit("")),
            _td(r["c_custkey"]),
            _td(F.concat(r["balance"], F.lit(" &amp; up"))),
            F.lit("</tr>"),
        ),
    )
    wide = F.concat(
        F.lit("<TR>"), _td(F.col("c_mktsegment"), " colspan='2'"), _td(F.size("m")), F.lit("</TR>")
    )
    pages = segment.groupBy("page_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "c_mktsegment",
                    F.array_join(spanned, "\n").alias("spanned"),
                    wide.alias("wide"),
                )
            )
        ).alias("s")
    )
    number = F.col("page_id").cast("string")
    sortable = F.concat(
        F.lit('<table class="wikitable sortable" id="a"><tr><th rowspan="2">segment '), number,
        F.lit('</th><th colspan="2">account</th></tr><tr><th> id </th><th>balance</th></tr>'),
        F.array_join(F.transform("s", lambda x: x["spanned"]), ""),
        F.lit("</table>"),
    )
    ignored = F.lit('<table class="wikitable sortable"><tr><th>x</th></tr><tr><td>y</td></tr></table>')
    collapsible = F.concat(
        F.lit('<p>text</p><table id="c" class="wikitable  collapsible"><tr><th>a</th><th>b</th><th>n '),
        number, F.lit("</th></tr>"),
        F.array_join(F.transform("s", lambda x: x["wide"]), ""),
        F.lit("</table>"),
    )
    collapsed = F.concat(
        F.lit("<table class='wikitable collapsed'><tr><th>k</th><th>v</th></tr><tr><td>1</td></tr><tr>"),
        F.when(F.col("page_id") % 5 == 0, F.lit("<td colspan=two>2</td>")).otherwise(F.lit("<td>2</td><td>3</td>")),
        F.lit("</tr></table>"),
    )
    html = F.concat(
        F.lit("<html><body><!-- <table class=\"wikitable sortable\"> -->"),
        sortable, ignored, collapsible,
        F.when(F.col("page_id") % 3 == 0, collapsed).otherwise(F.lit("")),
        F.lit("</body></html>"),
    )
    return pages.select(
        "page_id",
        F.concat(F.lit("page "), (F.col("page_id") % 7).cast("string")).alias("title"),
        F.concat(F.lit("http://example.org/en/"), number).alias("url"),
        html.alias("html"),
    )


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose table holds a table in a cell of every row, one page per block of customers.

    The outer table has a row per segment, with its number of customers; the cell between holds a
    table of their keys, two levels deep for the first one.
    """
    c = load(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / PAGE_BLOCK).cast("bigint").alias("page_id"), "c_custkey", "c_mktsegment")
    segment = c.groupBy("page_id", "c_mktsegment").agg(F.array_sort(F.collect_list("c_custkey")).alias("keys"))
    rows = F.transform("keys", lambda k, i: F.concat(
        F.lit("<tr>"), _td(F.concat(k.cast("string"), F.when(i == 0, F.lit("<table><tr><td>deep</td></tr></TABLE >")).otherwise(F.lit("")))), F.lit("</tr>")
    ))
    inner = F.concat(F.lit('<TABLE class="wikitable collapsible"><tr><th>key</th></tr>'), F.array_join(rows, ""), F.lit("</table>"))
    outer = F.concat(F.lit("<tr>"), _td("c_mktsegment"), _td(F.concat(F.lit("see "), inner, F.lit(" below"))), _td(F.size("keys")), F.lit("</tr>"))
    pages = segment.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("c_mktsegment", outer.alias("row")))).alias("s"))
    html = F.concat(
        F.lit('</table><table class="wikitable sortable"><tr><th>segment</th><th>keys</th><th>n</th></tr>'),
        F.array_join(F.transform("s", lambda x: x["row"]), ""), F.lit("</table><p>end</p>"),
    )
    return pages.select("page_id", html.alias("html"))
